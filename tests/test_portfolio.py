from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from data import rows_of
from tickloom.operators import portfolio, scoring


@pytest.fixture(scope="module")
def closes():
    rng = np.random.default_rng(2)
    dates = pd.date_range("2024-01-01", periods=30)
    wide = pd.DataFrame({s: 100 + rng.normal(size=30).cumsum() for s in "ABC"}, index=dates)
    wide.loc[dates[:2], "B"] = np.nan  # starts late
    wide.loc[dates[10], "C"] = np.nan  # interior gap
    return wide


def to_long(spark, wide):
    long = wide.rename_axis("date").reset_index().melt("date", var_name="symbol", value_name="close").dropna()
    return spark.createDataFrame(long).selectExpr("symbol", "to_date(date) date", "close")


def reference_returns(wide):
    return wide.ffill().pct_change(fill_method=None).dropna()


def test_aligned_returns_and_covariance(spark, closes):
    returns = portfolio.aligned_returns(to_long(spark, closes))
    wanted = reference_returns(closes)
    got = returns.toPandas().pivot(index="date", columns="symbol", values="ret")
    assert len(got) == len(wanted) == 27
    np.testing.assert_allclose(got.to_numpy(), wanted.to_numpy(), rtol=1e-12)
    cov = rows_of(portfolio.pairwise_covariance(returns), "a", "b")["cov"].to_numpy().reshape(3, 3)
    np.testing.assert_allclose(cov, wanted.cov().to_numpy(), rtol=1e-9)


def test_weights(spark, closes):
    weights = rows_of(portfolio.inverse_variance_weights(portfolio.aligned_returns(to_long(spark, closes))), "symbol")
    inverse = 1 / reference_returns(closes).var()
    np.testing.assert_allclose(weights["weight"], inverse / inverse.sum(), rtol=1e-9)


def test_equal_weights_without_variance(spark):
    df = spark.createDataFrame([("A", 0.1), ("B", 0.2)], "symbol string, ret double")
    assert [r["weight"] for r in portfolio.inverse_variance_weights(df).collect()] == [0.5, 0.5]


def reference_weights(wide, day, days):
    """Frame of the last closes of every symbol up to the day, aligned inside, then inverse variances."""
    seen = wide.loc[:day].dropna(axis=1, how="all")
    frame = pd.DataFrame({s: seen[s].dropna().tail(days) for s in seen})
    inverse = 1 / reference_returns(frame).var().replace(0, np.nan)
    if not inverse.notna().any():
        return pd.Series(1 / len(seen.columns), seen.columns)
    return (inverse / inverse.sum()).fillna(0)


@pytest.mark.parametrize("days", [10, 120])
def test_rebalance_with_late_flat_and_delisted_symbols(spark, closes, days):
    wide = closes.assign(FLAT=5.0, NEW=np.nan, GONE=closes["A"] * 2)
    wide.iloc[25:, wide.columns.get_loc("NEW")] = [1.0, 2.0, 1.5, 1.7, 1.2]
    wide.iloc[8:, wide.columns.get_loc("GONE")] = np.nan
    every = portfolio.rebalance_weights(to_long(spark, wide), days).toPandas()
    assert every["as_of"].nunique() == 29
    np.testing.assert_allclose(every.groupby("as_of")["weight"].sum(), 1)
    for stamp in wide.index[1:]:
        mine = every[every["as_of"] == stamp.date()].set_index("symbol")["weight"].sort_index()
        wanted = reference_weights(wide, stamp, days).sort_index()
        assert list(mine.index) == list(wanted.index)
        np.testing.assert_allclose(mine, wanted, rtol=1e-9, atol=1e-12)


def test_flat_symbol_gets_nothing(spark):
    df = spark.createDataFrame([(s, r) for s, rs in {"A": (1.0, 2.0), "B": (1.0, 3.0), "F": (0.0, 0.0)}.items() for r in rs], "symbol string, ret double")
    weights = {r["symbol"]: r["weight"] for r in portfolio.inverse_variance_weights(df).collect()}
    assert weights == pytest.approx({"A": 0.8, "B": 0.2, "F": 0.0})


def test_weights_of_one_day_match_the_series(spark, closes):
    df = to_long(spark, closes.drop(columns=["B"]))
    every = portfolio.rebalance_weights(df, days=10).toPandas()
    day = date(2024, 1, 25)
    one = portfolio.weights_as_of(df, day, days=10).toPandas().set_index("symbol")["weight"]
    mine = every[every["as_of"] == day].set_index("symbol")["weight"]
    np.testing.assert_allclose(mine.sort_index(), one.sort_index(), rtol=1e-9)


def test_refresh_rule():
    now = datetime(2024, 1, 2)
    assert portfolio.needs_refresh(None, now)
    assert portfolio.needs_refresh(now - timedelta(hours=24), now)
    assert not portfolio.needs_refresh(now - timedelta(hours=23), now)


def test_class_weights_and_f1(spark):
    pairs = [(1, 1), (1, 1), (1, 0), (0, 0), (0, 1), (-1, 1)]
    df = spark.createDataFrame(pairs, "bin int, pred int")
    weights = {r["bin"]: r["weight"] for r in scoring.class_balance(df, "bin").collect()}
    assert weights == {1: 6 / 9, 0: 1.0, -1: 2.0}
    f1_up, f1_flat = 2 * 2 / (3 + 4), 2 * 1 / (2 + 2)
    assert scoring.weighted_f1(df, "bin", "pred").first()["f1"] == pytest.approx((3 * f1_up + 2 * f1_flat) / 6)


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.2, 0.4, 0.4],)], "p array<double>")
    assert df.select(scoring.argmax_class(df["p"]).alias("c")).first()["c"] == 1
