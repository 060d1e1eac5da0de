import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from data import TICKS, minutes, rows_of, skewed_ticks
from tickloom.operators import bars, ledger
from tickloom.plans.live import trend_score
from tickloom.streaming import jobs
from tickloom.streaming.folds import STATE_SCHEMA


@pytest.fixture(scope="module")
def frame():
    return skewed_ticks(41, {"A": 600, "B": 90})


def as_files(spark, frame, folder, schema, cuts):
    """One file per cut, written and dated in order; rows inside a file are shuffled."""
    import os

    for i, part in enumerate(cuts):
        path = f"{folder}/part-{i:03d}.parquet"
        part.sample(frac=1.0, random_state=i).assign(ts=lambda d: d["ts"].astype("datetime64[us]")).to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return jobs.read_stream(spark, str(folder), schema, files_per_batch=1)


def time_cuts(frame, n):
    ordered = frame.sort_values("ts").reset_index(drop=True)
    size = -(-len(ordered) // n)
    return [ordered.iloc[i : i + size] for i in range(0, len(ordered), size)]


def thresholds(spark, limit):
    return spark.createDataFrame([("A", limit), ("B", limit)], "symbol string, threshold double")


def batch_bars(spark, frame, limit, until):
    df = spark.createDataFrame(frame[frame["ts"] < until]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return rows_of(bars.dollar_imbalance_bars(df, thresholds(spark, limit)), "symbol", "ts")


@pytest.mark.parametrize("cuts", [1, 4])
def test_stream_bars_equal_batch_bars(spark, frame, tmp_path, cuts):
    stream = as_files(spark, frame, tmp_path, TICKS, time_cuts(frame, cuts))
    got = rows_of(jobs.drain(jobs.stream_imbalance_bars(stream, thresholds(spark, 4000.0), "10 minutes"), "t", spark), "symbol", "ts")
    passed = (frame["ts"].max() - pd.Timedelta(minutes=10)).floor("ms")
    pd.testing.assert_frame_equal(got, batch_bars(spark, frame, 4000.0, passed))


def test_late_ticks_within_the_delay_are_put_in_order(spark, frame, tmp_path):
    first, second, third = time_cuts(frame, 3)
    swap = min(20, len(second))
    late = [
        pd.concat([first.iloc[:-swap], second.iloc[:swap]]),
        pd.concat([first.iloc[-swap:], second.iloc[swap:]]),
        third,
    ]
    delay = "3 hours"
    stream = as_files(spark, frame, tmp_path, TICKS, late)
    got = rows_of(jobs.drain(jobs.stream_imbalance_bars(stream, thresholds(spark, 4000.0), delay), "t", spark), "symbol", "ts")
    passed = (frame["ts"].max() - pd.Timedelta(hours=3)).floor("ms")
    pd.testing.assert_frame_equal(got, batch_bars(spark, frame, 4000.0, passed))


def test_stream_time_bars_are_final(spark, frame, tmp_path):
    stream = as_files(spark, frame, tmp_path, TICKS, time_cuts(frame, 3))
    got = rows_of(jobs.drain(jobs.stream_time_bars(stream, "5 minutes", "1 minute"), "t", spark), "symbol", "ts")
    df = spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    wanted = rows_of(bars.time_bars(df, "5 minutes"), "symbol", "ts")
    passed = frame["ts"].max() - pd.Timedelta(minutes=1)
    wanted = wanted[wanted["ts"] + pd.Timedelta(minutes=5) <= passed.floor("ms")].reset_index(drop=True)
    pd.testing.assert_frame_equal(got, wanted)


def test_stream_dedup_across_batches(spark, frame, tmp_path):
    part = frame.head(50)
    stream = as_files(spark, frame, tmp_path, TICKS, [part, part.assign(uid=part["uid"] + 1000), frame.iloc[50:]])
    got = jobs.drain(jobs.stream_dedup_ticks(stream, "1 day"), "t", spark)
    assert got.count() == len(frame)


def test_stream_scores_keep_enough_history(spark, frame, tmp_path):
    """Three batches: only the trailing rows are kept, yet the last score needs 200 bars."""
    closes = frame.rename(columns={"price": "close"})
    cuts = time_cuts(closes, 3)
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    schema = TICKS.replace("price", "close")
    stream = as_files(spark, closes, source, schema, cuts)
    jobs.start_scoring(stream, trend_score, str(root), 200, availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{root}/scores").filter("batch = 2 and symbol = 'A'").first()
    ordered = closes[closes["symbol"] == "A"].sort_values("ts")["close"]
    fast, slow = ordered.tail(50).mean(), ordered.tail(200).mean()
    assert got["conf"] == pytest.approx(0.6 + abs((fast - slow) / slow))
    assert got["signal"] == (1 if fast > slow else -1)
    kept = spark.read.parquet(f"{root}/history/batch=2").groupBy("symbol").count().toPandas()
    assert kept["count"].max() <= 200


def test_stream_orders_equal_batch_orders(spark, tmp_path):
    rows = [("A", minutes(i), i, 10.0, 0.01, [1, 0, 1, -1, -1][i % 5], 0.5 + (i % 4) / 10) for i in range(200)]
    schema = "symbol string, ts timestamp_ntz, uid bigint, close double, vol double, signal int, conf double"
    signals = spark.createDataFrame(rows, schema)
    frame = signals.toPandas()
    stream = as_files(spark, frame, tmp_path, schema, time_cuts(frame, 4))
    weights = spark.createDataFrame([("A", 1.0)], "symbol string, weight double")
    got = rows_of(jobs.drain(jobs.stream_order_intents(stream, weights, 5_000.0, "0 seconds"), "t", spark), "ts")
    wanted = rows_of(ledger.order_intents(signals, weights, 5_000.0), "ts")
    eligible = frame[(frame["signal"] != 0) & (frame["conf"] > 0.6)]
    wanted = wanted[wanted["ts"] < eligible["ts"].max()]
    pd.testing.assert_frame_equal(got, wanted.reset_index(drop=True))
    assert got["qty"].max() > 1 and got["take_profit"].notna().sum() == (got["action"] == "buy").sum()


def test_a_table_in_pieces_gives_the_bars_of_the_whole(spark, frame, monkeypatch):
    """No trigger takes in more than a piece, and none loses a row to the watermark."""
    monkeypatch.setattr(jobs, "PIECE_ROWS", 300)
    df = spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    stream, arrivals = jobs.in_pieces(df)
    assert len(arrivals.waiting) == 3
    sizes = [spark.read.parquet(piece).count() for piece in arrivals.waiting]
    assert sum(sizes) == len(frame) and max(sizes) < len(frame) / 2
    stream, closing = jobs.with_closing(stream)
    limits = thresholds(spark, 4000.0).union(spark.createDataFrame([(jobs.CLOSING_SYMBOL, 1e9)], "symbol string, threshold double"))
    made = jobs.drain(jobs.stream_imbalance_bars(stream, limits, "10 minutes"), "t", spark, closing, arrivals)
    pd.testing.assert_frame_equal(rows_of(made, "symbol", "ts"), batch_bars(spark, frame, 4000.0, pd.Timestamp("2199-01-01")))


def test_waiting_rows_are_kept_as_bytes(spark):
    """A number in a list of the state costs tens of microseconds a trigger."""
    kinds = {f.name: f.dataType.typeName() for f in T._parse_datatype_string(STATE_SCHEMA)}
    assert kinds == {"fold": "array", "times": "binary", "ids": "binary", "numbers": "binary"}


def test_order_intents_reach_the_stream_in_pieces(spark, monkeypatch):
    """No trigger takes in the whole table, and the rows are those of the batch operator."""
    monkeypatch.setattr(jobs, "PIECE_ROWS", 300)
    arrived, arrive = [], jobs.Arrivals.arrive
    monkeypatch.setattr(jobs.Arrivals, "arrive", lambda self: (arrived.append(1), arrive(self)))
    made, wanted = (entry.queries()[name](spark, "/root/testdata/sf0.001") for name in ("stream_order_intents", "order_intents"))
    assert len(arrived) > 2
    assert sorted(map(repr, made.collect())) == sorted(map(repr, wanted.select(*made.columns).collect()))
