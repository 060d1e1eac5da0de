"""Column helpers that tidy names, times and non-finite numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field names seen in trade feeds and the tick column each one means.
ALIASES = {
    "t": "timestamp",
    "p": "price",
    "s": "size",
    "v": "size",
    "vol": "size",
    "volume": "size",
    "c": "condition",
    "x": "exchange",
}

# Time layouts tried in order.
TIME_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]",
    "yyyy-MM-dd",
]


def normalize_columns(df: DataFrame, volume: bool = False) -> DataFrame:
    """Rename feed fields to tick columns; ``volume`` calls the size column volume."""
    names = {c: ALIASES[c] for c in df.columns if c in ALIASES}
    renamed = df.withColumnsRenamed(names)
    if volume and "volume" not in renamed.columns:
        renamed = renamed.withColumnRenamed("size", "volume")
    return renamed


def parse_mixed_ts(column: str | Column) -> Column:
    """UTC time without zone from ISO text with or without fraction and zone; null if unreadable."""
    text = F.col(column) if isinstance(column, str) else column
    return F.coalesce(
        F.try_to_timestamp(text), *(F.try_to_timestamp(text, F.lit(layout)) for layout in TIME_FORMATS)
    ).cast("timestamp_ntz")


def finite(column: str | Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    value = F.col(column) if isinstance(column, str) else column
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), value)


def safe_symbol(column: str | Column) -> Column:
    """Symbol usable as an identifier: dots and dashes become underscores."""
    return F.translate(column, ".-", "__")
