"""Trading calendar predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
OPEN_TIME = "09:30:00"
CLOSE_TIME = "16:00:00"


def market_time(ts: Column) -> Column:
    """Naive UTC to naive exchange-local time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(MARKET_ZONE), ts)


def _flag_day(df: DataFrame, day: Column, calendar: DataFrame) -> DataFrame:
    known = calendar.select(F.col("date").alias("_day"), F.lit(True).alias("_open")).distinct()
    return df.withColumn("_day", day).join(known, "_day", "left")


def with_trading_day(df: DataFrame, day: Column, calendar: DataFrame, name: str = "is_trading_day") -> DataFrame:
    """Whether ``day`` is a weekday listed in the calendar."""
    flagged = _flag_day(df, day, calendar)
    return flagged.withColumn(name, F.col("_open").isNotNull() & (F.weekday("_day") < 5)).drop("_day", "_open")


def with_market_open(df: DataFrame, ts: Column, calendar: DataFrame, name: str = "is_market_open") -> DataFrame:
    """Whether ``ts`` falls into trading hours, both ends included, exchange time."""
    local = df.withColumn("_local", market_time(ts))
    flagged = _flag_day(local, F.to_date("_local"), calendar)
    clock = F.date_format("_local", "HH:mm:ss.SSSSSS")
    in_hours = (clock >= f"{OPEN_TIME}.000000") & (clock <= f"{CLOSE_TIME}.000000")
    opened = F.col("_open").isNotNull() & (F.weekday("_day") < 5) & in_hours
    return flagged.withColumn(name, opened).drop("_local", "_day", "_open")
