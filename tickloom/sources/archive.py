"""Landing trades, tick archives, bar files and the ingest status log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.clean import normalize_columns
from tickloom.operators.ordered import keep_first, small_side

RETENTION_DAYS = 365
RECENT_DAYS = 365
MIN_BARS = 200


def ticks_from_trades(trades: DataFrame) -> DataFrame:
    """Trade messages ``symbol, t, p, s, c, x`` to tick rows."""
    return trades.select(
        "symbol",
        F.col("t").cast("timestamp_ntz").alias("ts"),
        F.col("p").cast("double").alias("price"),
        F.col("s").cast("double").alias("volume"),
        F.coalesce(F.concat_ws(",", "c"), F.lit("")).alias("conditions"),
        F.coalesce("x", F.lit("")).alias("tape"),
    )


def dedup_ticks(ticks: DataFrame) -> DataFrame:
    """One row per (symbol, ts, price, volume); the lowest uid stays."""
    return keep_first(ticks, ["symbol", "ts", "price", "volume"], ["uid"])


def load_ticks_range(ticks: DataFrame, start=None, end=None) -> DataFrame:
    """Time, price and volume in an inclusive range, in time order within each symbol."""
    if start is not None:
        ticks = ticks.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        ticks = ticks.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return ticks.select("symbol", "ts", "uid", "price", "volume").orderBy("symbol", "ts", "uid").drop("uid")


def unsigned_size(size: Column) -> Column:
    """Missing sizes count as 0, fractions are cut."""
    return F.floor(F.coalesce(size, F.lit(0))).cast("bigint")


def archive_rows(ticks: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    """The trailing window in archive types: UTC time, float price, whole size."""
    recent = ticks.filter(F.col("ts") >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp_ntz"))
    renamed = normalize_columns(recent.withColumnRenamed("ts", "timestamp"))
    return renamed.withColumns(
        {"price": F.col("price").cast("float"), "size": unsigned_size(F.col("size")), "date": F.to_date("timestamp")}
    )


def write_archive(ticks: DataFrame, root: str, as_of, days: int = RETENTION_DAYS) -> None:
    """Snappy Parquet by symbol and day, sorted by time so row-group statistics prune.

    Range partitioning on (symbol, time) spreads a hot symbol over many writers.
    """
    rows = archive_rows(ticks, as_of, days)
    placed = rows.repartitionByRange("symbol", "timestamp").sortWithinPartitions("symbol", "timestamp")
    placed.write.mode("overwrite").partitionBy("symbol", "date").option("compression", "snappy").parquet(root)


def _with_symbol(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """Parquet under ``root`` with a ``symbol``, from the rows, from ``symbol=`` folders or from ``[data/]<symbol>/<folder>/``.

    Where a symbol has files in both plain layouts those under ``data/`` count.
    """
    place = rf"(data/)?([^/=]+)/{folder}/[^/]+$"

    def placed(df: DataFrame, path: str) -> DataFrame:
        return df.withColumns(
            {"symbol": F.regexp_extract(path, place, 2), "_first": F.length(F.regexp_extract(path, place, 1)) > 0}
        )

    def below(reader: DataFrameReader) -> DataFrameReader:
        return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")

    files = placed(below(spark.read.format("binaryFile")).load(root).select("path"), "path").filter("symbol != ''")
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if files.isEmpty():
        return reader.parquet(root)
    kept = files.groupBy("symbol").agg(F.max("_first").alias("_first"))
    rows = placed(below(reader).parquet(root).withColumn("_path", F.col("_metadata.file_path")), "_path").filter("symbol != ''")
    return rows.join(small_side(kept), ["symbol", "_first"], "left_semi").drop("_path", "_first")


def scan_tick_archive(spark: SparkSession, root: str) -> DataFrame:
    """Every readable archive file under ``root`` as ticks; ``symbol`` comes from the path."""
    ticks = normalize_columns(_with_symbol(spark, root, "parquet"), volume=True)
    ticks = ticks.withColumnRenamed("timestamp", "ts")
    kinds = dict(ticks.dtypes)
    if kinds["ts"] == "bigint":  # nanoseconds since the epoch
        ticks = ticks.withColumn("ts", F.timestamp_micros(F.expr("ts div 1000")))
    if kinds["symbol"] != "string":
        ticks = ticks.withColumn("symbol", F.col("symbol").cast("string"))
    return ticks.withColumns(
        {
            "ts": F.col("ts").cast("timestamp_ntz"),
            "price": F.col("price").cast("double"),
            "volume": F.col("volume").cast("double"),
        }
    )


def first_layout(spark: SparkSession, root: str, symbol: str) -> str | None:
    """Folder of one symbol's archive: ``data/<symbol>/parquet`` wins over ``<symbol>/parquet``."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for folder in (f"{root}/data/{symbol}/parquet", f"{root}/{symbol}/parquet"):
        pattern = jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
        found = pattern.getFileSystem(conf).globStatus(pattern)
        if found is not None and len(found) > 0:
            return folder
    return None


def write_bars(bars: DataFrame, root: str) -> None:
    """One bar per (symbol, ts), partitioned by symbol."""
    bars.write.mode("overwrite").partitionBy("symbol").parquet(root)


def load_bars(spark: SparkSession, root: str) -> DataFrame:
    """Bars with a naive UTC ``ts``, whether it was stored as time or as nanoseconds; one file a symbol or partitioned."""
    bars = _with_symbol(spark, root, "bars")
    if "timestamp" in bars.columns:
        bars = bars.withColumnRenamed("timestamp", "ts")
    if dict(bars.dtypes)["ts"] == "bigint":
        bars = bars.withColumn("ts", F.timestamp_micros(F.expr("ts div 1000")))
    return bars.withColumns({"symbol": F.col("symbol").cast("string"), "ts": F.col("ts").cast("timestamp_ntz")})


def recent_bars(bars: DataFrame, as_of, days: int = RECENT_DAYS, least: int = MIN_BARS) -> DataFrame:
    """Bars of the last ``days`` for symbols that have at least ``least`` of them."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    recent = bars.filter(F.col("ts") >= since)
    enough = recent.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return recent.join(enough.select("symbol"), "symbol", "left_semi")


STATUSES = ("pending", "active", "archived")
STATUS_LOG = "symbol string, status string, last_date date, seq bigint"


def append_status(spark: SparkSession, updates: DataFrame, path: str) -> None:
    """Append ``symbol, status, last_date`` to the log under ``path``, which is made on first use.

    All rows of a call get the next number. One writer at a time; a status outside ``STATUSES`` fails the call.
    """
    known = F.col("status").isin(*STATUSES)
    checked = F.when(known, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), "status")))
    spark.createDataFrame([], STATUS_LOG).write.mode("append").parquet(path)
    last = spark.read.schema(STATUS_LOG).parquet(path).agg(F.max("seq")).first()[0] or 0
    rows = updates.select("symbol", checked.alias("status"), F.col("last_date").cast("date"), F.lit(last + 1).cast("bigint").alias("seq"))
    rows.write.mode("append").parquet(path)


def symbols_to_load(universe: DataFrame, log: DataFrame) -> DataFrame:
    """Symbols that are not archived yet, with the last loaded date; those without a status are pending."""
    now = universe.select("symbol").join(latest_status(log), "symbol", "left")
    status = F.coalesce("status", F.lit("pending"))
    return now.select("symbol", status.alias("status"), "last_date").filter(F.col("status") != "archived")


def latest_status(log: DataFrame) -> DataFrame:
    """Current ``status, last_date`` per symbol from an append-only log ordered by ``seq``."""
    newest = F.max_by(F.struct("status", "last_date"), "seq").alias("now")
    return log.groupBy("symbol").agg(newest).select("symbol", "now.status", "now.last_date")
