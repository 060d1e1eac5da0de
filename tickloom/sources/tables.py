"""Tick, close and calendar tables derived from the generic test tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.operators.ordered import numbered, running_sum, with_history

TICK_KEY = ["symbol"]
TICK_ORDER = ["ts", "uid"]


@lru_cache(maxsize=None)
def _schema(path: str) -> T.StructType:
    return SparkSession.active().read.parquet(path).schema


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; its footer is read for the schema once per process."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def _named(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("uid"),
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def ticks_from_events(events: DataFrame) -> DataFrame:
    """Independent price draws: ``symbol, ts, uid, price, volume``; batch or stream."""
    return _named(events).select(
        "symbol", "ts", "uid", F.col("value").alias("price"), F.col("k").cast("double").alias("volume")
    )


def ticks_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks_from_events(read_table(spark, sf_dir, "events"))


def ticks_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random-walk prices; the running sum is over integers, so it is exact."""
    events = _named(read_table(spark, sf_dir, "events"))
    walked = running_sum(events, TICK_KEY, TICK_ORDER, 2 * F.col("k") - 99, "moved")
    return walked.select(
        "symbol",
        "ts",
        "uid",
        ((100000 + F.col("moved")) / 100.0).alias("price"),
        (F.floor("value") + 1).cast("double").alias("volume"),
        "k",
        (100000 + F.col("moved")).alias("cents"),
    )


def bars_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk read as bars: one bar per tick, ``close`` is the price."""
    return ticks_walk(spark, sf_dir).withColumnRenamed("price", "close")


def ticks_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many symbols with day-grain timestamps.

    ``uid`` orders the ties inside one (symbol, ts).  Whole rows are unique, so a rank
    over the remaining columns is total, and (symbol, ts) keeps the groups small.
    """
    items = read_table(spark, sf_dir, "lineitem")
    rest = [c for c in items.columns if c not in ("l_suppkey", "l_shipdate")]
    ties = F.struct(*rest)
    return items.select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        F.col("l_shipdate").alias("ts"),
        ties.alias("uid"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
    )


HISTORY_SPAN = 50_000


def bars_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of bars from the order lines, a symbol for each flag and status: ``symbol, ts, uid, close, volume``.

    A walk of odd whole cents, folded back at 500 and 1500, so that prices stay positive and exact at any length; lines of one
    day follow each other by milliseconds.
    """
    items = read_table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.to_date("l_shipdate").alias("day"),
        "l_orderkey",
        "l_linenumber",
        (2 * (F.col("l_partkey") % 100) - 99).alias("step"),
        F.col("l_quantity").alias("volume"),
    )
    placed = numbered(items, ["symbol", "day"], ["l_orderkey", "l_linenumber"], "uid")
    timed = placed.withColumn("ts", F.timestamp_millis(F.unix_millis(F.col("day").cast("timestamp")) + F.col("uid") - 1).cast("timestamp_ntz"))
    # A symbol too large for one task is written in runs: only what is needed.
    needed = timed.select("symbol", "ts", "uid", "step", "volume")
    walked = running_sum(needed, TICK_KEY, TICK_ORDER, F.col("step"), "moved")
    turn = F.lit(2 * HISTORY_SPAN)
    cents = 2 * HISTORY_SPAN + F.abs(F.pmod(F.col("moved") + HISTORY_SPAN, 2 * turn) - turn) - HISTORY_SPAN
    return walked.select("symbol", "ts", "uid", (cents / 100.0).alias("close"), "volume")


def daily_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last walk price per symbol and day: ``symbol, date, close``."""
    return (
        ticks_walk(spark, sf_dir)
        .groupBy("symbol", F.to_date("ts").alias("date"))
        .agg(F.max_by("price", F.struct("ts", "uid")).alias("close"))
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays spanned by the events, with the first Monday taken out as a holiday."""
    span = read_table(spark, sf_dir, "events").agg(
        F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi")
    )
    days = span.select("lo", F.explode(F.sequence("lo", "hi")).alias("date"))
    holiday = F.next_day(F.date_sub("lo", 1), "Mon")
    return days.filter((F.weekday("date") < 5) & (F.col("date") != holiday)).select("date")


def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event type plus one symbol without data: ``symbol, rank``.

    Ranking needs one ordered list, so the distinct names are sorted as an array.
    """
    names = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    absent = spark.createDataFrame([("absent",)], "symbol string")
    listed = names.unionByName(absent).agg(F.sort_array(F.collect_list("symbol")).alias("names"))
    return listed.select(F.posexplode("names").alias("rank", "symbol")).select("symbol", "rank")


def signals_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-based signals on the walk: ``symbol, ts, uid, close, signal, conf``.

    The signal is the sign of the price against its 20-row mean, compared as whole cents;
    the confidence runs from 0.45 to 0.945.
    """

    def compute(df: DataFrame, keys: list[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*TICK_ORDER).rowsBetween(-19, 0)
        lean = F.signum(20 * F.col("cents") - F.sum("cents").over(window)).cast("int")
        return df.withColumn("signal", F.when(F.count("cents").over(window) >= 20, lean).otherwise(0))

    signalled = with_history(bars_walk(spark, sf_dir), TICK_KEY, TICK_ORDER, 20, compute)
    return signalled.select("symbol", "ts", "uid", "close", "signal", ((90 + F.col("k")) / 200.0).alias("conf"))
