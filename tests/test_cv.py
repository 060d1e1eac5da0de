import numpy as np
import pytest

from data import minutes, rows_of
from tickloom.operators import cv


def samples(spark, sizes, reach):
    rng = np.random.default_rng(5)
    rows = [
        (symbol, minutes(i), minutes(i + int(rng.integers(0, reach))))
        for symbol, n in sizes.items()
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "symbol string, t0 timestamp_ntz, t1 timestamp_ntz")


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_purged_folds_equal_the_published_splitter(spark, small_blocks, block):
    small_blocks(block)
    df = samples(spark, {"A": 113, "B": 57}, 15)
    got = rows_of(cv.purged_folds(df, 5, 0.03), "symbol", "fold", "t0")
    for symbol, group in df.toPandas().groupby("symbol"):
        times = group.sort_values("t0").set_index("t0")["t1"]
        n, embargo = len(times), int(len(times) * 0.03)
        for fold, test in enumerate(np.array_split(np.arange(n), 5)):
            begin, end = times.index[test[0]], times.iloc[test].max()
            after = times.index.searchsorted(end) + embargo
            train = {i for i in range(n) if (times.iloc[i] <= begin or i >= after) and i not in set(test)}
            mine = got[(got["symbol"] == symbol) & (got["fold"] == fold)].reset_index(drop=True)
            assert set(np.flatnonzero(mine["role"] == "test")) == set(test)
            assert set(np.flatnonzero(mine["role"] == "train")) == train


def test_no_training_label_overlaps_the_test_labels(spark):
    got = cv.purged_folds(samples(spark, {"A": 100}, 20)).toPandas()
    for _, fold in got.groupby("fold"):
        test = fold[fold["role"] == "test"]
        train = fold[fold["role"] == "train"]
        overlap = (train["t0"] < test["t1"].max()) & (train["t1"] > test["t0"].min())
        assert not overlap.any()


def test_pooled_folds_leave_no_symbol_in_the_test_time_of_another(spark):
    frame = samples(spark, {"A": 60, "B": 90}, 20)
    got = cv.purged_folds(frame, pooled=True).toPandas()
    assert len(got) == 5 * 150 and set(got["symbol"]) == {"A", "B"}
    for _, fold in got.groupby("fold"):
        test, train = fold[fold["role"] == "test"], fold[fold["role"] == "train"]
        assert len(test) == 30
        assert not ((train["t0"] < test["t1"].max()) & (train["t1"] > test["t0"].min())).any()


@pytest.mark.parametrize("n", [5, 7, 12, 104, 3])
def test_fold_sizes(spark, n):
    got = rows_of(cv.cv_fold_id(samples(spark, {"A": n}, 1), order=["t0"]), "t0")
    wanted = np.concatenate([[i] * len(part) for i, part in enumerate(np.array_split(np.arange(n), 5))])
    assert got["fold"].tolist() == wanted.astype(int).tolist()


def test_time_split(spark):
    got = rows_of(cv.time_split(samples(spark, {"A": 7}, 1), order=["t0"]), "t0")
    assert got["is_test"].tolist() == [False] * 5 + [True] * 2
