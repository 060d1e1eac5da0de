import pandas as pd
import pytest
from pyspark.sql import functions as F

from data import rows_of, skewed_ticks, to_spark
from tickloom.operators import ordered
from tickloom.operators.ordered import history

KEYS, ORDER = ["symbol"], ["ts", "uid"]
SIZES = {"hot": 900, "warm": 130, "cold": 7, "one": 1}


@pytest.fixture(scope="module")
def frame():
    return skewed_ticks(1, SIZES, ties=True)


def test_small_table_needs_no_counting_job(spark, frame):
    df = to_spark(spark, frame.head(100))
    assert ordered.estimated_bytes(df) * ordered.ROWS_PER_BYTE <= ordered.DEFAULT_BLOCK_ROWS
    assert ordered.rows_to_split(df, KEYS) is None


def test_a_hot_key_of_well_compressed_rows_is_noticed(spark, small_blocks, tmp_path):
    """Far less than a byte a row."""
    spark.range(200_000).select(F.lit("hot").alias("symbol"), F.lit(1.0).alias("price")).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    small_blocks(100_000)
    assert ordered.estimated_bytes(df) < 100_000 / 4
    assert ordered.rows_to_split(df, KEYS) == 200_000


def test_hot_key_is_noticed(spark, frame, small_blocks):
    small_blocks(100)
    df = to_spark(spark, frame)
    assert ordered.group_sizes(df, KEYS) == (900, sum(SIZES.values()))
    assert ordered.rows_to_split(df, KEYS) == sum(SIZES.values())


@pytest.mark.parametrize("block", [2_000_000, 100, 33])
def test_numbered(spark, frame, small_blocks, block):
    small_blocks(block)
    got = rows_of(ordered.numbered(to_spark(spark, frame), KEYS, ORDER), "symbol", "ts", "uid")
    wanted = frame.sort_values(["symbol", "ts", "uid"]).groupby("symbol").cumcount() + 1
    assert got["pos"].tolist() == wanted.tolist()


@pytest.mark.parametrize("block", [2_000_000, 100])
def test_running_sum_and_last(spark, frame, small_blocks, block):
    small_blocks(block)
    df = to_spark(spark, frame)
    df = ordered.running_sum(df, KEYS, ORDER, F.col("volume"), "total")
    df = ordered.lagged(df, KEYS, ORDER, "price", "before")
    df = ordered.running_last(df, KEYS, ORDER, F.when(F.col("volume") > 17, F.col("uid")), "big")
    got = rows_of(df, "symbol", "ts", "uid")
    wanted = frame.sort_values(["symbol", "ts", "uid"]).reset_index(drop=True)
    assert got["total"].tolist() == wanted.groupby("symbol")["volume"].cumsum().tolist()
    before = wanted.groupby("symbol")["price"].shift(1)
    pd.testing.assert_series_equal(got["before"], before, check_names=False)
    big = wanted["uid"].where(wanted["volume"] > 17).groupby(wanted["symbol"]).ffill()
    pd.testing.assert_series_equal(got["big"].astype(float), big.astype(float), check_names=False)


@pytest.mark.parametrize("block", [2_000_000, 60])
def test_with_history_equals_plain_window(spark, frame, small_blocks, block):
    small_blocks(block)

    def compute(df, keys):
        window = history(keys, ORDER).rowsBetween(-40, 0)
        return df.withColumn("mean", F.avg("price").over(window)).withColumn("n", F.count("price").over(window))

    got = rows_of(ordered.with_history(to_spark(spark, frame), KEYS, ORDER, 40, compute), "symbol", "ts", "uid")
    wanted = frame.sort_values(["symbol", "ts", "uid"]).groupby("symbol")["price"].rolling(41, min_periods=1)
    assert len(got) == len(frame)
    assert got["mean"].round(9).tolist() == wanted.mean().round(9).tolist()
    assert got["n"].tolist() == wanted.count().astype(int).tolist()


def test_hot_key_is_spread_over_partitions(spark, frame, small_blocks):
    small_blocks(100)
    cut = ordered.split(to_spark(spark, frame), KEYS, ORDER)
    sizes = cut.groupBy("symbol", ordered.PART).count().toPandas()
    assert (sizes["symbol"] == "hot").sum() > 4
    assert sizes["count"].max() < 400


def test_keep_first(spark, frame):
    df = to_spark(spark, frame)
    got = rows_of(ordered.keep_first(df, ["symbol", "ts"], ["uid"]), "symbol", "ts")
    wanted = frame.sort_values("uid").drop_duplicates(["symbol", "ts"]).sort_values(["symbol", "ts"])
    assert got["uid"].tolist() == wanted["uid"].tolist()
    assert list(got.columns) == list(frame.columns)


def test_broadcast_hint_only_below_the_measured_limit(spark, frame, monkeypatch):
    df = to_spark(spark, frame).select("symbol").distinct()
    monkeypatch.setattr(ordered, "estimated_bytes", lambda df: 1 << 40)
    hinted = ordered.small_side(df)._jdf.queryExecution().logical().toString()
    assert "ResolvedHint" in hinted or "UnresolvedHint" in hinted
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 1)
    assert "Hint" not in ordered.small_side(df)._jdf.queryExecution().logical().toString()
