"""Rates of documents that bring the expected tokens of soft domains to target weights.

A classifier fitted on labelled rows gives each text a posterior over domains (soft membership). A
document of ``n`` tokens then brings ``n * p_k * rate`` expected tokens to domain ``k``. The rates
are the nonnegative solution, next to one, of the least squares between these sums and the targets,
by projected gradient: each pass sums tokens over the documents in parallel, and the step of a
document is its posterior times a vector of the size of the domains. So only these short
vectors pass the driver, and the rate of a document is folded from them where it is needed.
Steps are scaled by the document's tokens, so long and short texts of one posterior get one rate, and
carried on with momentum, which short passes need when domains differ much in size.

The classifier is a soft-max regression on words, present or not, fitted on at most ``SAMPLE_ROWS``
labelled rows; its features are the ``FEATURES`` words that say most about the domains in these rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tickloom.llm.common import batches, id_and_text, with_columns, written

FEATURES = 1 << 12
LEAST_ROWS = 3  # labelled rows that a feature occurs in
SAMPLE_ROWS = 4_000
BLOCK = 1 << 14
DOMAINS = {"toxic": "toxic = 1", "good": "quality = 1", "plain": "quality = 0"}
TARGETS = {"toxic": 0.0, "good": 0.9, "plain": 0.1}


@dataclass
class Posteriors:
    """``words``: sorted hashes of the features; ``weights``: feature by domain, the last row is the bias."""

    words: np.ndarray
    weights: np.ndarray

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[int]]:
        scores, sizes = np.tile(self.weights[-1], (len(texts), 1)), []
        for row, text in zip(scores, texts):
            present, n = word_presence(text)
            sizes.append(n)
            if len(self.words):
                spots = np.minimum(np.searchsorted(self.words, present), len(self.words) - 1)
                row += self.weights[spots[self.words[spots] == present]].sum(axis=0)
        return _softmax(scores), sizes


def word_presence(text: bytes | None) -> tuple[np.ndarray, int]:
    """Sorted hashes of the words that occur, and the number of all words."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh32_intdigest
    return np.unique(np.array([digest(w) for w in set(words)], np.uint32)), len(words)


def labelled_domains(labels: DataFrame, domains: dict[str, str], rows: int, id_col: str = "doc_id") -> list[tuple[int, str]]:
    """At most ``rows`` pairs (id, domain), as even over the domains as they allow; the first condition that holds names it."""
    which = F.coalesce(*(F.when(F.expr(rule), F.lit(name)) for name, rule in domains.items()))
    named = labels.select(F.col(f"`{id_col}`").cast("long").alias("i"), which.alias("domain")).where("i is not null and domain is not null")
    first = named.groupBy("i").agg(F.min("domain").alias("domain"))
    place = F.row_number().over(W.partitionBy("domain").orderBy(F.xxhash64("i"), "i"))
    each = max(1, rows // max(1, len(domains)))
    return [(r["i"], r["domain"]) for r in first.withColumn("n", place).where(F.col("n") <= each).collect()]


def fit_posteriors(
    docs: DataFrame, pairs: list[tuple[int, str]], names: list[str], shares: np.ndarray, passes: int = 150, decay: float = 2e-3
) -> Posteriors:
    """The regression on the labelled rows of ``docs(__id, __text)``; only their word sets reach the driver.

    The sample is even over the domains; the bias is moved back to their real ``shares``.
    """
    known = docs.sparkSession.sparkContext.broadcast(dict(pairs))  # SAMPLE_ROWS at most

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = [
            (known.value[i], word_presence(t)[0].tobytes())
            for i, t in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist())
            if i in known.value
        ]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["domain", "words"])

    # A repeated id could bring any number of rows: equal ones count once, and the number is bounded.
    found = batches(docs, step, "domain string, words binary").distinct().orderBy(F.xxhash64("words"), "domain")
    rows = found.limit(SAMPLE_ROWS).collect()
    bias = np.log(np.maximum(shares, 1e-6))
    if not rows:
        return Posteriors(np.zeros(0, np.uint32), bias[None, :])
    sets = [np.frombuffer(r["words"], np.uint32) for r in rows]
    y = np.array([[r["domain"] == n for n in names] for r in rows], np.float32)
    words = _telling(sets, y)
    x = np.zeros((len(rows), len(words) + 1), np.float32)
    x[:, -1] = 1
    for row, present in zip(x, sets):
        row[np.flatnonzero(np.isin(words, present, assume_unique=True))] = 1
    # Nesterov's method on the mean log loss, with a step that the largest curvature allows.
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        probe = x.T @ (x @ probe)
        probe /= np.linalg.norm(probe)
    rate = 2 / (np.linalg.norm(x @ probe) ** 2 / len(x) + decay)
    last = np.zeros((x.shape[1], len(names)), np.float32)
    ahead = last
    for n in range(passes):
        now = ahead - rate * (x.T @ (_softmax(x @ ahead) - y) / len(x) + decay * ahead)
        ahead = now + n / (n + 3) * (now - last)
        last = now
    weights = last.astype(np.float64)
    even = y.mean(axis=0)
    weights[-1] += np.where(even > 0, bias - np.log(np.maximum(even, 1e-6)), -30)
    return Posteriors(words, weights)


def _telling(sets: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words that tell most about the domains: mutual information of presence and domain."""
    words, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    present = np.stack([np.bincount(place, weights=y[owner, k], minlength=len(words)) for k in range(y.shape[1])], axis=1)
    total, n = y.sum(axis=0), len(y)
    gain = np.zeros(len(words))
    for counts in (present, total - present):
        expected = counts.sum(axis=1, keepdims=True) * total / n
        gain += (counts * np.log(np.where(counts > 0, counts, 1) / np.where(counts > 0, expected, 1))).sum(axis=1)
    gain[present.sum(axis=1) < LEAST_ROWS] = -1
    best = np.lexsort((words, -gain))[:FEATURES]
    return np.sort(words[best[gain[best] >= 0]])


def _softmax(scores: np.ndarray) -> np.ndarray:
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def with_posteriors(docs: DataFrame, model: Posteriors, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tokens`` (words) and ``__p`` (posterior of each domain)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        made, sizes = shared.value.of(texts)
        return [pa.array(sizes, pa.int64()), pa.array(list(made), pa.list_(pa.float64()))]

    fields = [T.StructField("__tokens", T.LongType()), T.StructField("__p", T.ArrayType(T.DoubleType()))]
    return with_columns(docs, text_col, compute, fields)


def folded(p: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the given steps, from one, and the point ahead of them where the next step is taken.

    A step is a vector over the domains, whose product with the posterior is taken off before the cut at zero,
    and the momentum that carries the point ahead.
    """
    rate = np.ones(len(p))
    ahead = rate
    for g, momentum in steps:
        new = np.maximum(0.0, ahead - p @ g)
        ahead = new + momentum * (new - rate)
        rate = new
    return rate, ahead


def _in_blocks(held: DataFrame) -> DataFrame:
    """Tokens and posteriors of up to ``BLOCK`` documents in a row, for the many passes over them."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shares, rows = [], [], 0

        def close() -> pa.RecordBatch:
            packed = [b"".join(tokens)], [b"".join(shares)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in packed], names=["tokens", "p"])

        for batch in stream:
            tokens.append(np.asarray(batch.column("__tokens")).astype(float).tobytes())
            shares.append(np.asarray(batch.column("__p").flatten()).tobytes())
            rows += batch.num_rows
            if rows >= BLOCK:
                yield close()
                tokens, shares, rows = [], [], 0
        if rows:
            yield close()

    return held.select("__tokens", "__p").mapInArrow(run, "tokens binary, p binary")


def solve_rates(
    held: DataFrame, targets: np.ndarray, passes: int = 80, tolerance: float = 1e-4
) -> list[tuple[np.ndarray, float]]:
    """The steps that lead to the rates; ``held(__tokens, __p)`` is summed once a pass.

    ``targets`` are shares of all tokens. Ends when no domain is off by more than ``tolerance`` of
    all tokens, when three passes change no more than a hundredth of it, or after ``passes``.
    """
    size = len(targets)
    blocks = written(_in_blocks(held), "mixing")

    def total(make: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = np.zeros(width)
            for batch in stream:
                for tokens, p in zip(batch.column("tokens").to_pylist(), batch.column("p").to_pylist()):
                    made += make(np.frombuffer(p).reshape(-1, size), np.frombuffer(tokens))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(made)], names=["k", "v"])

        rows = blocks.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(width)
        for r in rows:
            out[r["k"]] = r["v"]
        return out

    moments = total(lambda p, n: np.concatenate([(p.T * n @ p).ravel(), n @ p]), size * size + size)
    second, tokens = moments[: size * size].reshape(size, size), moments[size * size :].sum()
    if not tokens:
        return []
    wanted = targets / max(targets.sum(), 1e-12) * tokens
    length = 1 / np.linalg.eigvalsh(second).max()  # of a step that never overshoots
    steps: list[tuple[np.ndarray, float]] = []
    last, still, turn = None, 0, 1.0
    for _ in range(passes):
        both = total(lambda p, n, done=tuple(steps): np.concatenate([(n * w) @ p for w in folded(p, done)]), 2 * size)
        reached, ahead = both[:size], both[size:]
        if np.abs(reached - wanted).max() <= tolerance * tokens:
            break
        if last is not None:
            still = still + 1 if np.abs(reached - last).max() <= tolerance / 100 * tokens else 0
            if still == 3:
                break
            if ((ahead - wanted) @ (reached - last)) > 0:
                turn = 1.0  # the momentum points uphill: start it anew
        new = (1 + (1 + 4 * turn * turn) ** 0.5) / 2
        steps.append((length * (ahead - wanted), (turn - 1) / new))
        last, turn = reached, new
    return steps


def with_rates(
    docs: DataFrame,
    labels: DataFrame,
    domains: dict[str, str] = DOMAINS,
    targets: dict[str, float] = TARGETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with ``__tokens``, ``__p`` (in the order of ``domains``) and ``__rate`` (0 or more).

    A null or empty text has no tokens, the domains' base posterior and a rate like any other. Repeated
    rows get equal rates. Without labels every posterior is the same. An empty table gives none.
    """
    names = list(domains)
    which = F.coalesce(*(F.when(F.expr(rule), F.lit(name)) for name, rule in domains.items()))
    seen = {r["d"]: r["n"] for r in labels.groupBy(which.alias("d")).agg(F.count("*").alias("n")).collect()}
    counts = np.array([seen.get(n, 0) for n in names], float)
    shares = counts / counts.sum() if counts.sum() else np.full(len(names), 1 / len(names))
    model = fit_posteriors(id_and_text(docs, id_col, text_col), labelled_domains(labels, domains, SAMPLE_ROWS), names, shares)
    slim = docs.select(F.col(f"`{text_col}`").alias("__t"))
    steps = solve_rates(with_posteriors(slim, model, "__t"), np.array([targets.get(n, 0.0) for n in names]))
    # The texts are read again rather than kept: the posteriors of a second reading are the same.
    made = with_posteriors(docs, model, text_col)
    columns, place = [f"__c{i}" for i in range(len(made.columns))], made.columns.index("__p")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = np.asarray(batch.column(place).flatten()).reshape(-1, len(names))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded(p, steps)[0])], names=[*columns, "__rate"])

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(columns, made.schema)] + [T.StructField("__rate", T.DoubleType())])
    return batches(made.toDF(*columns), step, schema).toDF(*made.columns, "__rate")


def mixed_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, p_<domain>..., rate`` for every row of ``docs``."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = with_rates(slim, labels, id_col="doc_id")
    shares = [F.col("__p")[i].alias(f"p_{name}") for i, name in enumerate(DOMAINS)]
    return made.select("doc_id", F.col("__tokens").alias("n_tokens"), *shares, F.col("__rate").alias("rate"))
