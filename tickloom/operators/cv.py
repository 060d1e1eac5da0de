"""Time-ordered splits: train/test slice, contiguous folds, purged and embargoed folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.ordered import is_cut, numbered, small_side, split
from tickloom.session import reliable

N_FOLDS = 5
EMBARGO = 0.01
TEST_SHARE = 0.20


def _sized(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``pos`` (1-based) and ``n`` per key."""
    cut = split(df, keys, order)
    placed = numbered(cut, keys, order, "pos", True)
    if not is_cut(cut):
        return placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, list(keys)).select(*df.columns, "pos", "n")


def time_split(
    df: DataFrame, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",), test: float = TEST_SHARE
) -> DataFrame:
    """Add ``is_test``: rows after the first ``floor(n * (1 - test))`` of each key."""
    placed = _sized(df, keys, order)
    return placed.withColumn("is_test", F.col("pos") > F.floor(F.col("n") * F.lit(1 - test))).drop("pos", "n")


def fold_of(pos: Column, n: Column, k: int) -> Column:
    """0-based contiguous fold of a 1-based position; the first ``n % k`` folds get one more row."""
    small, larger = F.floor(n / k), n % k
    border = larger * (small + 1)
    zero = pos - 1
    late = larger + F.floor(F.try_divide(zero - border, small))
    return F.when(zero < border, F.floor(zero / (small + 1))).otherwise(late).cast("int")


def cv_fold_id(
    df: DataFrame, k: int = N_FOLDS, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)
) -> DataFrame:
    placed = _sized(df, keys, order)
    return placed.withColumn("fold", fold_of(F.col("pos"), F.col("n"), k)).drop("pos", "n")


def purged_folds(
    samples: DataFrame, k: int = N_FOLDS, embargo: float = EMBARGO, key: str = "symbol", pooled: bool = False
) -> DataFrame:
    """Role of every sample in every fold: ``test``, ``train`` or ``purged``.

    ``samples`` carries ``symbol, t0, t1``.  A sample trains a fold when it ends no later
    than the fold's first test sample starts, or comes more than ``floor(embargo * n)`` rows
    after the last sample starting before the test labels end.  Folds are cut per symbol, for one model a symbol;
    ``pooled`` cuts them on the time of all symbols together, for one model over all of them: then no symbol
    trains on the time on which another is tested.
    """
    group, order = ("_all", ["t0", key]) if pooled else (key, ["t0"])
    # Read several times below: written once, so that the labels are not made again each time.
    written = reliable(samples.select(key, "t0", "t1", *([F.lit(0).alias("_all")] if pooled else [])))
    placed = _sized(written, [group], order).withColumn("own_fold", fold_of(F.col("pos"), F.col("n"), k))
    edges = placed.groupBy(group, F.col("own_fold").alias("fold")).agg(
        F.min("t0").alias("test_start"), F.max("t1").alias("test_end")
    )
    # ``edges`` has k rows per key, so both joins widen the samples k times, as the result does.
    edges = small_side(edges)
    started = placed.join(edges, group).filter("t0 < test_end")
    reach = started.groupBy(group, "fold").agg(F.max("pos").alias("reach"))
    bounds = edges.join(reach, [group, "fold"], "left")
    after = F.coalesce("reach", F.lit(0)) + F.floor(embargo * F.col("n"))
    role = (
        F.when(F.col("own_fold") == F.col("fold"), "test")
        .when(F.col("t1") <= F.col("test_start"), "train")
        .when(F.col("pos") > after, "train")
        .otherwise("purged")
    )
    return placed.join(small_side(bounds), group).select("fold", key, "t0", "t1", role.alias("role"))


def fold_masks(samples: DataFrame, k: int = N_FOLDS, embargo: float = EMBARGO) -> DataFrame:
    """``samples`` with ``_fold``, the pooled fold that tests it, and ``_trains``, whose bit ``i`` says that it trains fold ``i``.

    Samples that share symbol and interval get the roles of all of them: they train a fold only together.
    """
    keys = ["symbol", "t0", "t1"]
    roles = purged_folds(samples, k, embargo, pooled=True)
    trains = F.when(F.col("role") == "train", F.expr("shiftleft(1L, fold)")).otherwise(F.lit(0).cast("long"))
    by_fold = roles.withColumn("_bit", trains).groupBy(*keys, "fold").agg(F.min("_bit").alias("_bit"), F.max(F.col("role") == "test").alias("_own"))
    marks = by_fold.groupBy(*keys).agg(F.sum("_bit").alias("_trains"), F.min(F.when(F.col("_own"), F.col("fold"))).alias("_fold"))
    return samples.join(marks, keys)
