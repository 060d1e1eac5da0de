"""Streaming queries, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features, labels
from tickloom.plans import market_data, sql
from tickloom.plans.market_data import r
from tickloom.plans.registry import query
from tickloom.plans.research import FEATURE_CTES, INTENTS_SQL
from tickloom.session import fresh_path, reliable
from tickloom.sources import tables
from tickloom.streaming import jobs

DELAY = "1 hour"


def tick_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of ticks."""
    schema = tables.read_table(spark, sf_dir, "events").schema
    events = jobs.read_stream(spark, sf_dir, schema, glob="events.parquet")
    return tables.ticks_from_events(events)


@query(
    "stream_imbalance_bars",
    sql.ask(
        sql.TICKS + sql.imbalance_bars("SELECT DISTINCT symbol, 20000.0::DOUBLE AS threshold FROM ticks"),
        market_data.BARS_OUT,
    ),
)
def stream_imbalance_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, arrivals = jobs.in_pieces(tables.read_table(spark, sf_dir, "events"))
    ticks, closing = jobs.with_closing(tables.ticks_from_events(events))
    # The closing row needs a threshold to reach the watermark behind the join. Every trigger reads them: made once.
    known = tables.ticks_events(spark, sf_dir)
    thresholds = reliable(market_data.fixed_thresholds(known.unionByName(closing.rows(), allowMissingColumns=True)))
    bars = jobs.stream_imbalance_bars(ticks, thresholds, DELAY)
    return market_data._bars_out(jobs.drain(bars, "stream-bars", spark, closing, arrivals))


@query(
    "stream_time_bars",
    sql.ask(f"{sql.TICKS}, {market_data.TIME_BARS.format(unit='minute')}", "SELECT tb.* FROM tb"),
)
def stream_time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks, closing = jobs.with_closing(tick_stream(spark, sf_dir))
    bars = jobs.stream_time_bars(ticks, "1 minute", DELAY)
    return jobs.drain(bars, "stream-time-bars", spark, closing)


@query(
    "stream_dedup_ticks",
    sql.ask(
        sql.TICKS,
        """SELECT DISTINCT symbol, date_trunc('day', ts) AS ts, floor(price / 10) AS price,
        floor(volume / 10) AS volume FROM ticks""",
    ),
)
def stream_dedup_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = tick_stream(spark, sf_dir).select(
        "symbol",
        F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"),
        F.floor(F.col("price") / 10).cast("double").alias("price"),
        F.floor(F.col("volume") / 10).cast("double").alias("volume"),
    )
    return jobs.drain(jobs.stream_dedup_ticks(coarse, "1 day"), "stream-dedup", spark)


def trend_score(bars: DataFrame) -> DataFrame:
    """Rule in place of a model: follow the trend, the surer the stronger it is."""
    made = features.windowed(bars, features.add_trend, features.SLOW_WINDOW)
    return made.select(
        "symbol",
        "ts",
        F.signum("trend_strength").cast("int").alias("signal"),
        (0.6 + F.abs("trend_strength")).alias("conf"),
    )


trend_score.lookback = features.SLOW_WINDOW


def _written_stream(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    path = fresh_path(spark, label)
    frame.write.parquet(path)
    return jobs.read_stream(spark, path, frame.schema)


@query(
    "stream_scores",
    sql.ask(
        FEATURE_CTES,
        """SELECT symbol, ts, CAST(sign(trend_strength) AS INTEGER) AS signal, round(0.6::DOUBLE + abs(trend_strength), 6) AS conf
        FROM wf WHERE trend_strength <> 0 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1""",
    ),
)
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_walk(spark, sf_dir).select("symbol", "ts", "uid", "close", "volume")
    root = fresh_path(spark, "scores")
    stream = _written_stream(spark, bars, "bars")
    jobs.start_scoring(stream, trend_score, root, features.SLOW_WINDOW, availableNow=True).awaitTermination()
    return spark.read.parquet(f"{root}/scores").select("symbol", "ts", "signal", r("conf"))


@query("stream_order_intents", INTENTS_SQL)
def stream_order_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = reliable(labels.with_volatility(tables.signals_walk(spark, sf_dir)))
    weights = reliable(signals.select("symbol").distinct().withColumn("weight", F.lit(0.2)))
    pieces, arrivals = jobs.in_pieces(signals)
    stream, closing = jobs.with_closing(pieces)
    made = jobs.drain(jobs.stream_order_intents(stream, weights, 100_000.0, DELAY), "stream-intents", spark, closing, arrivals)
    return made.select("symbol", "ts", "action", "qty", r("take_profit"), r("stop_loss"))
