"""Aligned returns, covariance and weights over a bounded universe of daily closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_SYMBOLS = 50
LOOKBACK_DAYS = 120
REFRESH_HOURS = 24


def top_universe(universe: DataFrame, n: int = TOP_SYMBOLS) -> DataFrame:
    return universe.filter(F.col("rank") < n)


def _grid(closes: DataFrame, days: int) -> DataFrame:
    """``symbol, k, date, ret, start`` for every symbol and every date from its first close on.

    ``k`` numbers the dates of all symbols; a close is carried forward up to the next one; ``start`` is the number of
    the first of the last ``days`` closes. Every close unfolds into the dates that it fills, so no
    pairs of symbols and dates are made that are not in the result.
    """
    # One row per calendar date, so small windows.
    dates = closes.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    dates = dates.withColumn("_last", F.max("k").over(Window.partitionBy()))
    past = Window.partitionBy("symbol").orderBy("k")
    own = closes.filter(F.col("close").isNotNull()).join(dates, "date")
    start = F.coalesce(F.lag("k", days - 1).over(past), F.first("k").over(past))
    until = F.coalesce(F.lead("k").over(past) - 1, F.col("_last"))
    placed = own.select("symbol", "close", F.col("k").alias("_k"), start.alias("start"), until.alias("_until"))
    filled = placed.select("symbol", "close", "start", F.explode(F.sequence("_k", "_until")).alias("k"))
    moved = filled.withColumn("ret", F.try_divide("close", F.lag("close").over(past)) - 1)
    named = dates.select(F.col("k").alias("_day"), F.col("date").alias("_date"))
    return moved.join(named, moved["k"] == named["_day"]).select(
        "symbol", "k", F.col("_date").alias("date"), "ret", "start"
    )


def aligned_returns(closes: DataFrame) -> DataFrame:
    """Daily simple returns on dates where every symbol has one.

    ``closes`` is ``symbol, date, close``.  Gaps are filled forward first, so an interior
    gap is a zero return and only dates before a symbol's second close drop out.
    """
    grid = _grid(closes, LOOKBACK_DAYS)
    total = closes.agg(F.count_distinct("symbol").alias("_symbols"))
    known = grid.groupBy("date").agg(F.count("ret").alias("_known")).join(F.broadcast(total))
    return grid.join(known.filter("_known = _symbols").select("date"), "date").select("symbol", "date", "ret")


def pairwise_covariance(returns: DataFrame) -> DataFrame:
    """Sample covariance for every ordered pair of symbols of a bounded universe (``top_universe``).

    Half of the pairs are computed, the others are their mirror images.
    """
    left = returns.select("date", F.col("symbol").alias("a"), F.col("ret").alias("ra"))
    right = returns.select("date", F.col("symbol").alias("b"), F.col("ret").alias("rb"))
    half = left.join(right, "date").filter("a <= b").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("cov"))
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    return half.select(F.explode(sides).alias("_pair"), "cov").select("_pair.a", "_pair.b", "cov")


def _shares(inverse: Column, total: Column, symbols: Column) -> Column:
    """Shares of the known inverse variances; a symbol without one gets nothing, unless none is known."""
    return F.when(total.isNull(), 1.0 / symbols).otherwise(F.coalesce(F.try_divide(inverse, total), F.lit(0.0)))


def inverse_variance_weights(returns: DataFrame) -> DataFrame:
    """Weights proportional to 1 / variance, which sum to one; equal weights where no variance is known."""
    inverse = returns.groupBy("symbol").agg(F.try_divide(F.lit(1.0), F.var_samp("ret")).alias("_inv"))
    totals = inverse.agg(F.sum("_inv").alias("_total"), F.count(F.lit(1)).alias("_n"))
    weight = _shares(F.col("_inv"), F.col("_total"), F.col("_n"))
    return inverse.join(F.broadcast(totals)).select("symbol", weight.alias("weight"))


def weights_as_of(closes: DataFrame, as_of, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Weights from the trailing ``days`` closes before ``as_of``."""
    by_day = Window.partitionBy("symbol").orderBy(F.desc("date"))
    recent = closes.filter(F.col("date") <= F.lit(as_of)).withColumn("_age", F.row_number().over(by_day))
    return inverse_variance_weights(aligned_returns(recent.filter(F.col("_age") <= days).drop("_age")))


def rebalance_weights(closes: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Weights of every day, each from the last ``days`` closes of every symbol up to it.

    Returns are aligned inside the frame of each day: a symbol that is new shortens the frames it is in
    and leaves earlier days alone. A day on which no variance is known yet has equal weights; days before
    anybody's second close have none.
    """
    grid = _grid(closes, days)
    frames = grid.groupBy("k").agg(F.max("start").alias("_from"), F.count("ret").alias("_known")).filter("_known > 0")
    # Dates on which a symbol has no return (its first close, or a close of zero before) are left out.
    whole = grid.groupBy("k").agg(F.count("ret").alias("_rets"), F.count(F.lit(1)).alias("_rows")).filter("_rets = _rows")
    spread = frames.filter("_from < k").select(
        F.col("k").alias("_day"), F.explode(F.sequence(F.col("_from") + 1, F.col("k"))).alias("k")
    )
    inside = spread.join(whole.select("k"), "k").join(grid.select("symbol", "k", "ret"), "k")
    inverse = inside.groupBy(F.col("_day").alias("k"), "symbol").agg(
        F.try_divide(F.lit(1.0), F.var_samp("ret")).alias("_inv")
    )
    rows = grid.join(frames.select("k"), "k").join(inverse, ["k", "symbol"], "left")
    day = Window.partitionBy("k")
    weight = _shares(F.col("_inv"), F.sum("_inv").over(day), F.count(F.lit(1)).over(day))
    return rows.select(F.col("date").alias("as_of"), "symbol", weight.alias("weight"))


def needs_refresh(last_run, now, hours: int = REFRESH_HOURS) -> bool:
    """Whether a scheduled job should recompute weights."""
    return last_run is None or (now - last_run).total_seconds() >= hours * 3600
