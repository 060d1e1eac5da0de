"""Row-ordered work per key, for keys of any size.

Almost every operator here reads "the rows of one symbol in time order".  A plain
window over ``partitionBy(symbol)`` does that with one shuffle, but puts a whole
symbol in one task, which fails once a single symbol carries a large share of the
ticks.  Each helper below therefore has two exact plans and picks by measured size:

* every group fits in one task: the plain window over the key;
* otherwise: a range shuffle on (key, order) cuts the hot key into consecutive runs.
  ``numbered`` derives row positions from per-run counts, ``with_history`` windows
  over fixed-size blocks that also hold the last rows of the block before, and
  ``running_sum`` / ``running_last`` carry one value per run.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.session import reliable

BLOCK_ROWS_KEY = "spark.tickloom.blockRows"
# Four tasks of an executor hold that many rows at once, with their history and as pandas frames of some twenty columns.
DEFAULT_BLOCK_ROWS = 400_000
# A file may hold many rows in a byte, such as runs of equal values; below this the groups are not counted.
ROWS_PER_BYTE = 64
# Rows of a few dozen bytes each: some ten megabytes per executor at most.
BROADCAST_ROWS = 200_000

PART = "_run"
SLOT = "_slot"


def block_rows(spark: SparkSession) -> int:
    """Most rows of one key that a single task should hold."""
    return int(spark.conf.get(BLOCK_ROWS_KEY, str(DEFAULT_BLOCK_ROWS)))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate, the figure its broadcast decision uses."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    try:
        return int(str(stats.sizeInBytes()))
    except ValueError:  # the product of many joins may have more digits than Python reads
        return sys.maxsize


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and rows of all, in one pass over the key columns."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = sizes.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def rows_to_split(df: DataFrame, keys: Sequence[str]) -> int | None:
    """Number of rows if some key is too large for one task, else None."""
    limit = block_rows(df.sparkSession)
    # Too few bytes for any group to exceed the limit: no counting job needed.
    if estimated_bytes(df) * ROWS_PER_BYTE <= limit:
        return None
    largest, total = group_sizes(df, keys)
    return total if largest > limit else None


def small_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its row count, measured, allows one.

    For sides with one row per symbol or per run.  Where the estimate is already below
    Spark's own limit nothing is measured.
    """
    own_limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if estimated_bytes(df) <= own_limit:
        return df
    written = reliable(df)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def history(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], total: int) -> DataFrame:
    """Globally ordered, written rows tagged with their run (range partition).

    A run holds consecutive rows of a key; a hot key owns many runs.  ``order`` must
    be total within a key so the cut never depends on arrival order.  ``total`` is the
    number of rows, which sets the number of runs.
    """
    pieces = max(1, -(-total // block_rows(df.sparkSession)))
    ordered = df.repartitionByRange(pieces, *keys, *order).sortWithinPartitions(*keys, *order)
    # Tagged before they are written: a file may be read in several parts, and several in one.
    return reliable(ordered.withColumn(SLOT, F.monotonically_increasing_id()).withColumn(PART, F.shiftright(SLOT, 33).cast("int")))


def split(df: DataFrame, keys: Sequence[str], order: Sequence[str], checked: bool = False) -> DataFrame:
    """``df`` cut into runs if a key is too large for one task, else ``df`` itself.

    The helpers below cut on their own.  Cutting first and passing ``checked=True`` to
    them lets several share one measurement and one cut.
    """
    if checked or PART in df.columns:
        return df
    total = rows_to_split(df, keys)
    return df if total is None else runs(df, keys, order, total)


def join_and_split(df: DataFrame, side: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` joined with one row per key, then cut if ``df`` needs it.

    The size is measured before the join: the estimate of a join is a product, which would
    ask for a count of the joined rows.
    """
    total = None if is_cut(df) else rows_to_split(df, keys)
    joined = df.join(small_side(side), list(keys))
    return joined if total is None else runs(joined, keys, order, total)


def is_cut(df: DataFrame) -> bool:
    return PART in df.columns


def _uncut(df: DataFrame, source: DataFrame) -> DataFrame:
    return df if is_cut(source) else df.drop(PART, SLOT)


def earlier_runs(keys: Sequence[str]) -> WindowSpec:
    return history(keys, [PART]).rowsBetween(Window.unboundedPreceding, -1)


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", checked: bool = False
) -> DataFrame:
    """1-based row number per key."""
    cut = split(df, keys, order, checked)
    if not is_cut(cut):
        return df.withColumn(name, F.row_number().over(history(keys, order)).cast("long"))
    return _uncut(_numbered_by_runs(cut, keys, name), df)


def _numbered_by_runs(cut: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    counts = cut.groupBy(*keys, PART).agg(F.min(SLOT).alias("_first"), F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        *keys, PART, "_first", F.coalesce(F.sum("_n").over(earlier_runs(keys)), F.lit(0)).alias("_before")
    )
    return (
        cut.join(small_side(offsets), [*keys, PART])
        .withColumn(name, F.col(SLOT) - F.col("_first") + F.col("_before") + 1)
        .drop("_first", "_before")
    )


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lookback: int,
    compute: Callable[[DataFrame, list[str]], DataFrame],
    checked: bool = False,
) -> DataFrame:
    """Run ``compute(df, keys)`` where a result row needs at most ``lookback`` earlier rows.

    For a hot key the rows go to blocks of fixed size by position; the last
    ``lookback`` rows of a block are copied into the next one and dropped again
    after ``compute``, which must keep every input column.
    """
    keys = list(keys)
    cut = split(df, keys, order, checked)
    if not is_cut(cut):
        return compute(df, keys)
    size = max(block_rows(df.sparkSession), lookback)
    placed = _numbered_by_runs(cut, keys, "_pos").withColumn("_home", F.expr(f"(_pos - 1) div {size}"))
    in_tail = F.col("_pos") - 1 - F.col("_home") * size >= size - lookback
    copies = F.when(in_tail, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))
    spread = placed.withColumn("_block", F.explode(copies)).drop("_pos")
    done = compute(spread, [*keys, "_block"]).filter("_home = _block").drop("_home", "_block")
    return _uncut(done, df)


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the run columns of a cut frame."""
    return df.select(*names, *(c for c in (SLOT, PART) if c in df.columns and c not in names))


def lagged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, checked: bool = False
) -> DataFrame:
    """Value of ``column`` in the row before.  A run takes its first one from the run before it."""
    cut = split(df, keys, order, checked)
    if not is_cut(cut):
        return df.withColumn(name, F.lag(column).over(history(keys, order)))
    ends = cut.groupBy(*keys, PART).agg(F.max_by(column, SLOT).alias("_end"))
    carried = ends.select(*keys, PART, F.lag("_end").over(history(keys, [PART])).alias("_carried"))
    window = history([*keys, PART], order)
    first = F.row_number().over(window) == 1
    shifted = (
        cut.withColumn("_first", first)
        .withColumn(name, F.lag(column).over(window))
        .join(small_side(carried), [*keys, PART])
        .withColumn(name, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col(name)))
        .drop("_first", "_carried")
    )
    return _uncut(shifted, df)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, checked: bool = False
) -> DataFrame:
    """Sum of ``value`` from the key's first row to the current one."""
    cut = split(df.withColumn("_value", value), keys, order, checked)
    if not is_cut(cut):
        window = history(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        return cut.withColumn(name, F.sum("_value").over(window)).drop("_value")
    carried = (
        cut.groupBy(*keys, PART)
        .agg(F.sum("_value").alias("_total"))
        .select(*keys, PART, F.coalesce(F.sum("_total").over(earlier_runs(keys)), F.lit(0)).alias("_carried"))
    )
    window = history([*keys, PART], order).rowsBetween(Window.unboundedPreceding, 0)
    summed = (
        cut.withColumn(name, F.sum("_value").over(window))
        .join(small_side(carried), [*keys, PART])
        .withColumn(name, F.col(name) + F.col("_carried"))
        .drop("_value", "_carried")
    )
    return _uncut(summed, df)


def running_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, checked: bool = False
) -> DataFrame:
    """Latest non-null ``value`` up to and including the current row."""
    cut = split(df.withColumn("_value", value), keys, order, checked)
    if not is_cut(cut):
        window = history(keys, order).rowsBetween(Window.unboundedPreceding, 0)
        return cut.withColumn(name, F.last("_value", ignorenulls=True).over(window)).drop("_value")
    carried = (
        cut.groupBy(*keys, PART)
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(SLOT))).alias("_final"))
        .select(*keys, PART, F.last("_final", ignorenulls=True).over(earlier_runs(keys)).alias("_carried"))
    )
    window = history([*keys, PART], order).rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        cut.withColumn(name, F.last("_value", ignorenulls=True).over(window))
        .join(small_side(carried), [*keys, PART])
        .withColumn(name, F.coalesce(name, "_carried"))
        .drop("_value", "_carried")
    )
    return _uncut(filled, df)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in ``order``; the aggregate combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if rest == list(order) and len(rest) == 1:
        return df.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0])).select(*df.columns)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
