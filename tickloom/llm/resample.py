"""Quality by importance resampling.

Two generative models of hashed word n-grams (one and two words) are counted: one over labelled good
texts, one over all texts. The log of the ratio of the two, summed over a text, is its
importance weight. Adding a Gumbel variable to each log weight and keeping the k largest draws k
texts without replacement in proportion to the weights.

The raw model counts every text. The target model counts a bounded sample of the labelled good
rows (``TARGET_ROWS``). The k-th largest value is found by counting rows in ever
narrower ranges, so nothing is sorted in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.llm.common import batches, id_and_text, written

BUCKETS = 1 << 16
TARGET_ROWS = 20_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_buckets(text: bytes | None) -> np.ndarray:
    """The bucket of every word and every pair of words in a row, repeats included."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh64_intdigest
    one = np.array([digest(w) for w in words], np.uint64)
    two = one[:-1] * MIX + one[1:]
    return (np.concatenate([one, two * MIX]) >> np.uint64(48)).astype(np.int64)


def label_sample(labels: DataFrame, condition: str, rows: int, id_col: str = "doc_id") -> list[int]:
    """Ids of at most ``rows`` labelled rows that meet the condition, in the order of a hash."""
    ids = labels.where(condition).select(F.col(f"`{id_col}`").cast("long").alias("i")).where("i is not null").distinct()
    return [r["i"] for r in ids.orderBy(F.xxhash64("i"), "i").limit(rows).collect()]


def log_ratios(docs: DataFrame, good: list[int]) -> np.ndarray:
    """Log of target over raw probability for every bucket; ``docs(__id, __text)`` are all counted."""
    chosen = docs.sparkSession.sparkContext.broadcast(np.array(sorted(good), np.int64))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        ids = set(chosen.value.tolist())
        for batch in stream:
            made = [gram_buckets(t) for t in batch.column("__text").to_pylist()]
            good_ones = [m for doc, m in zip(batch.column("__id").to_pylist(), made) if doc in ids]
            for counts, parts in ((raw, made), (target, good_ones)):
                if parts:
                    counts += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        some = np.flatnonzero(raw)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"]
            )

    counts = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target"))
    table = np.zeros((BUCKETS, 2))
    for bucket, raw, target in counts.collect():  # BUCKETS rows at most
        table[bucket] = raw, target
    share = (table + 1) / (table.sum(axis=0) + BUCKETS)
    return np.log(share[:, 1]) - np.log(share[:, 0]) if table[:, 1].any() else np.zeros(BUCKETS)


def weighed(docs: DataFrame, ratios: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, log_weight, sample_key`` of ``docs(__id, __text)``; equal rows get equal Gumbel variables."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = batch.column("__id"), batch.column("__text").to_pylist()
        weights = np.array([shared.value[gram_buckets(t)].sum() for t in texts])
        draws = [xxhash.xxh64_intdigest(b"%s|%s" % (str(i).encode(), t or b""), seed) for i, t in zip(ids.to_pylist(), texts)]
        uniform = (np.array(draws, np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53 + 2.0**-54
        keys = weights - np.log(-np.log(uniform))
        return pa.RecordBatch.from_arrays([ids, pa.array(weights), pa.array(keys)], names=["doc_id", "log_weight", "sample_key"])

    return batches(docs, step, "doc_id long, log_weight double, sample_key double")


def kth_largest(table: DataFrame, column: str, k: int) -> tuple[float, int] | None:
    """The k-th largest value and how many of its equals belong to the first k; None when all rows do."""
    need, held = k, table.select(F.col(column).alias("x"))
    row = held.agg(F.min("x"), F.max("x"), F.count("x")).first()
    low, high, n = row
    if n <= k:
        return None
    if k <= 0:
        return float("inf"), 0
    # Halve the range into many parts until one value is left; every pass counts all rows of the range.
    parts = 1 << 12
    while low < high:
        width = (high - low) / parts
        if width <= 0 or low + width == low or high - width == high:
            break
        part = F.least(F.floor((F.col("x") - F.lit(low)) / F.lit(width)), F.lit(parts - 1))
        inside = held.where((F.col("x") >= F.lit(low)) & (F.col("x") <= F.lit(high)))
        counts = inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for got in counts.orderBy(F.desc("part")).collect():  # ``parts`` rows at most
            if need <= got["n"]:
                low, high = got["lo"], got["hi"]
                break
            need -= got["n"]
    if low < high:  # neighbours in the last digits: few distinct values are left
        for got in held.where(F.col("x").between(low, high)).groupBy("x").count().orderBy(F.desc("x")).toLocalIterator():
            if need <= got["count"]:
                return got["x"], need
            need -= got["count"]
    return high, need


def resample(
    docs: DataFrame,
    labels: DataFrame,
    target: str = "quality = 1 AND toxic = 0",
    fraction: float | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, log_weight, sample_key, selected`` for every row of ``docs``.

    ``fraction`` of the rows is drawn, or, where it is None, the share that the target has among the
    labelled rows. Null and empty texts have weight 0; ties at the last place go to the smaller id (null last).
    Without labelled targets all weights are 0 and the draw is uniform.
    """
    slim = id_and_text(docs, id_col, text_col)
    if fraction is None:
        share = labels.agg(F.avg(F.when(F.expr(target), 1.0).otherwise(0.0))).first()[0]
        fraction = 1.0 if share is None else share
    ratios = log_ratios(slim, label_sample(labels, target, TARGET_ROWS))
    made = written(weighed(slim, ratios, seed), "resample")
    cut = kth_largest(made, "sample_key", round(made.count() * fraction))
    if cut is None:
        return made.withColumn("selected", F.lit(True))
    value, spare = cut
    clear = made.where(F.col("sample_key") != F.lit(value)).withColumn("selected", F.col("sample_key") > F.lit(value))
    # Only rows that tie at the last place are numbered; distinct rows have distinct variables.
    order = W.orderBy(F.col("doc_id").asc_nulls_last())
    tied = made.where(F.col("sample_key") == F.lit(value)).withColumn("selected", F.row_number().over(order) <= spare)
    return clear.union(tied)
