"""Continuous versions of the batch operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.bars import BAR_SCHEMA, IMBALANCE_START, imbalance_step
from tickloom.operators.folds import Arrays, Fold, State
from tickloom.operators.ledger import LIVE_CONFIDENCE, POSITION_FOLD, eligible_signals, priced_intents
from tickloom.operators.scoring import latest_per_symbol
from tickloom.session import fresh_path
from tickloom.streaming.folds import stream_fold, with_event_time

DEDUP_KEY = ["symbol", "ts", "price", "volume"]


# --- imbalance bars -------------------------------------------------------------------------


def signed_step(state: State, rows: Arrays) -> tuple[Arrays, State]:
    """Tick sign and bar in one step: state is previous price (nan at first), sign, bar state."""
    before, sign, *bar = state
    change = np.sign(np.diff(rows["price"], prepend=before))
    change[np.isnan(change)] = 0
    # Each flat takes the sign at the last change; position 0 stands for the carried sign.
    moved = np.concatenate(([sign], change))
    last = np.maximum.accumulate(np.where(moved != 0, np.arange(len(moved)), 0))
    signs = moved[last][1:]
    bars, after = imbalance_step(tuple(bar), {**rows, "sign": signs})
    return bars, (float(rows["price"][-1]), float(signs[-1]), *after)


STREAM_BARS = Fold(
    ["ts", "price", "volume", "threshold"], (float("nan"), 1.0, *IMBALANCE_START), BAR_SCHEMA, signed_step
)


def stream_imbalance_bars(ticks: DataFrame, thresholds: DataFrame, delay: str) -> DataFrame:
    """Bars from a tick stream; ``thresholds`` is a static table."""
    return stream_fold(ticks.join(thresholds.select("symbol", "threshold"), "symbol"), "symbol", STREAM_BARS, delay)


# --- time bars, duplicates ------------------------------------------------------------------


def stream_time_bars(ticks: DataFrame, interval: str, delay: str) -> DataFrame:
    first = F.struct("ts", "uid")
    return (
        with_event_time(ticks, delay)
        .groupBy("symbol", F.window("event_time", interval).alias("w"))
        .agg(
            F.min_by("price", first).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", first).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
    )


def stream_dedup_ticks(ticks: DataFrame, delay: str) -> DataFrame:
    """One row per (symbol, ts, price, volume); a key is forgotten ``delay`` after its time."""
    return with_event_time(ticks, delay).dropDuplicatesWithinWatermark(DEDUP_KEY).drop("event_time")


# --- scores and orders ----------------------------------------------------------------------


def score_batches(
    new_bars: DataFrame,
    history_path: str,
    score: Callable[[DataFrame], DataFrame],
    sink_path: str,
    rows_needed: int,
    gate: float = LIVE_CONFIDENCE,
) -> Callable[[DataFrame, int], None]:
    """Batch function: keep the new bars, score the latest one per symbol over enough history.

    ``score`` maps bars to rows with ``symbol, ts, signal, conf``.  A batch keeps the last
    ``rows_needed`` bars per symbol for the next one, so its cost does not grow with the
    age of the stream.  Output goes under the batch number: a repeated batch replaces
    itself, and the history it starts from is that of the batch before.  A ``score`` that says how
    many rows it looks back on, in an attribute ``lookback``, is refused if that is more than is kept.
    """
    if getattr(score, "lookback", 0) > rows_needed:
        raise ValueError(f"the score looks back on {score.lookback} bars, {rows_needed} are kept")
    columns = new_bars.columns

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = batch.select(*columns)
        if number > 0:
            before = spark.read.schema(known.schema).parquet(f"{history_path}/batch={number - 1}")
            known = before.select(*columns).unionByName(known)
        newest = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("uid"))
        # row_number <= n lets Spark keep only n rows per symbol and task before the shuffle.
        recent = known.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= rows_needed).drop("_age")
        folder = f"{history_path}/batch={number}"
        recent.write.mode("overwrite").parquet(folder)
        kept = spark.read.schema(known.schema).parquet(folder)
        fresh = batch.select("symbol").distinct()
        latest = latest_per_symbol(score(kept.join(fresh, "symbol", "left_semi")).select("symbol", "ts", "signal", "conf"))
        latest.filter(F.col("conf") > gate).write.mode("overwrite").parquet(f"{sink_path}/batch={number}")

    return run


def start_scoring(
    new_bars: DataFrame, score: Callable[[DataFrame], DataFrame], root: str, rows_needed: int, **trigger
) -> StreamingQuery:
    """Score on every trigger, by default once a minute; scores land in ``<root>/scores``."""
    run = score_batches(new_bars, f"{root}/history", score, f"{root}/scores", rows_needed)
    trigger = trigger or {"processingTime": "1 minute"}
    return (
        new_bars.writeStream.foreachBatch(run)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(**trigger)
        .start()
    )


def stream_order_intents(
    signals: DataFrame, weights: DataFrame, portfolio_value: float, delay: str, least_conf: float = LIVE_CONFIDENCE
) -> DataFrame:
    """Sized intents of a signal stream, the rows of ``order_intents``; ``weights`` is a static table."""
    acted = stream_fold(eligible_signals(signals, least_conf), "symbol", POSITION_FOLD, delay)
    return priced_intents(acted.join(weights, "symbol"), portfolio_value)


# --- running to the end of the available input ----------------------------------------------


# No symbol of the data; far enough ahead for every watermark to pass the last row, and within nanoseconds.
CLOSING_SYMBOL = "#end"
CLOSING_TIME = "2200-01-01 00:00:00"


@dataclass
class Closing:
    """A second source of a stream, empty until the end: one row that moves the watermark past all others."""

    spark: SparkSession
    schema: T.StructType
    path: str

    def rows(self) -> DataFrame:
        """The closing row: the reserved symbol, the far time, and one in every number."""
        known = {"symbol": F.lit(CLOSING_SYMBOL), "ts": F.lit(CLOSING_TIME)}
        numbers = (T.NumericType,)
        return self.spark.range(1).select(
            *(
                known.get(f.name, F.lit(1) if isinstance(f.dataType, numbers) else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in self.schema
            )
        )

    def arrive(self) -> None:
        self.rows().write.mode("append").parquet(self.path)


def with_closing(stream: DataFrame) -> tuple[DataFrame, Closing]:
    """``stream`` and its closing source, to be passed to ``drain``; apply it before the watermark."""
    spark = stream.sparkSession
    closing = Closing(spark, stream.schema, fresh_path(spark, "closing"))
    closing.rows().limit(0).write.parquet(closing.path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(closing.path)), closing


PIECE_ROWS = 1_000_000


@dataclass
class Arrivals:
    """A table that reaches a stream in pieces, the earliest first, so that no trigger takes in or holds more than a piece."""

    spark: SparkSession
    path: str
    waiting: list[str]

    def arrive(self) -> None:
        piece = self.waiting.pop(0)
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        folder = place(self.path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(place(piece), folder)


def in_pieces(df: DataFrame, ts: str = "ts") -> tuple[DataFrame, Arrivals]:
    """Stream of ``df`` and its arrivals, to be passed to ``drain``; rows of one time come in one piece."""
    spark = df.sparkSession
    staged, path = fresh_path(spark, "staged"), fresh_path(spark, "arrived")
    df.repartitionByRange(max(1, -(-df.count() // PIECE_ROWS)), ts).write.parquet(staged)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place(path))
    # Files are named by partition, and partitions go by time.
    pieces = sorted(str(f.getPath().toString()) for f in files.listStatus(place(staged)) if f.getPath().getName().startswith("part-"))
    return read_stream(spark, path, df.schema), Arrivals(spark, path, pieces)


def drain(stream: DataFrame, label: str, spark: SparkSession, closing: Closing | None = None, arrivals: Arrivals | None = None) -> DataFrame:
    """Process everything available into a Parquet table in the shared folder and read it.

    Without ``closing`` the rows that the watermark has not passed stay in the state. With it the stream is
    resumed once more with the closing row, so the table is that of the whole input. With ``arrivals`` it is resumed for every piece.
    """
    root = fresh_path(spark, label)

    def run() -> None:
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{root}/rows")
            .option("checkpointLocation", f"{root}/progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    if arrivals is None or not arrivals.waiting:
        run()
    while arrivals is not None and arrivals.waiting:
        arrivals.arrive()
        run()
    if closing is not None:
        closing.arrive()
        run()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def read_stream(spark: SparkSession, path: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
