"""Ranked lexical search over K2-treaps: quadtrees of a grid of terms and documents whose cells store impact maxima.

The documents are cut into shards. In each, terms are rows (by falling number of documents, so rare ones lie together) and
documents are columns. The grid is a square of ``2**height`` cells a side; every node of the tree stands for a square that
holds postings, stores which of its four quarters do (4 bits) and the largest impact inside. Nodes of a level
stand one after the other in Morton order, so the children of a node are found by counting bits: no pointers are stored.

An item descends the paths of its terms' rows together. A range of documents is bounded by the sum of the
terms' weights times the maxima of the squares that hold their row; the most promising ranges are halved first, and what
cannot reach the best ``k`` so far is left. At single cells the maxima are the impacts, so scores are exact.

An impact depends on the term's count in the document and on the document's length only; weights depend on how many
documents hold a term and are applied when searching. Items travel to the shards, in groups of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, batches, id_and_text, written

BEST = 20
SHARD_DOCS, SHARD_TERMS = 1 << 12, 1 << 21
GROUP_TERMS = 200_000  # terms of the items that a task holds at once
FRONT = 256  # ranges that are halved at once
CHUNK = 1 << 24
SHARDS = "shard long, terms binary, ids binary, holders binary, tree binary"

_WORD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def term_runs(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some megabytes at a time: runs of letters, digits and non-ASCII bytes, A-Z in small letters."""
    lo = 0
    while lo < len(text):
        hi = min(lo + CHUNK, len(text))
        while hi < len(text) and _WORD[text[hi]] != 32:
            hi += 1
        yield text[lo:hi].translate(_WORD).split()
        lo = hi


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def _spread(x: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2**32 at the even places."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


class Treap:
    """Levels from the root (0) to the cells (``height``): child masks of all but the last, maxima of all."""

    def __init__(self, masks: list[np.ndarray], maxima: list[np.ndarray]) -> None:
        self.masks, self.maxima, self.height = masks, maxima, len(masks)
        self.starts = [np.cumsum(np.bitwise_count(m), dtype=np.int64) - np.bitwise_count(m) for m in masks]

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> Treap:
        """From distinct cells, of which there is at least one."""
        height = max(int(rows.max()), int(columns.max())).bit_length()
        codes = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(codes)
        codes, maxima, masks = codes[order], [values[order].astype(np.uint32)], []
        for _ in range(height):
            quarter, up = np.uint8(1) << (codes & np.uint64(3)).astype(np.uint8), codes >> np.uint64(2)
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]]))
            masks.append(np.bitwise_or.reduceat(quarter, first))
            maxima.append(np.maximum.reduceat(maxima[-1], first))
            codes = up[first]
        return cls(masks[::-1], maxima[::-1])

    def packed(self) -> bytes:
        sizes = np.array([self.height, *map(len, self.maxima)], np.int64)
        planes = np.concatenate(self.maxima).view(np.uint8).reshape(-1, 4).T
        masks = np.concatenate(self.masks) if self.masks else np.zeros(0, np.uint8)
        return sizes.tobytes() + zstandard.compress(masks.tobytes() + planes.tobytes(), 1)

    @classmethod
    def unpacked(cls, blob: bytes) -> Treap:
        height = int(np.frombuffer(blob, np.int64, 1)[0])
        sizes = np.frombuffer(blob, np.int64, height + 1, 8)
        raw = np.frombuffer(zstandard.decompress(blob[8 * (height + 2) :]), np.uint8)
        inner = int(sizes[:-1].sum())
        masks = np.split(raw[:inner], np.cumsum(sizes[:-1])[:-1]) if height else []
        values = np.ascontiguousarray(raw[inner:].reshape(4, -1).T).view(np.uint32).ravel()
        return cls(masks, np.split(values, np.cumsum(sizes)[:-1]))

    def _children(self, level: int, nodes: np.ndarray, rows: np.ndarray, side: int) -> np.ndarray:
        """Nodes of the next level on the rows' paths in the left (0) or right (1) half of the columns; -1 where there is none."""
        bit = (rows >> (self.height - 1 - level)) & 1
        quarter = (2 * bit + side).astype(np.uint8)
        mask = np.where(nodes >= 0, self.masks[level][nodes], 0).astype(np.uint8)
        before = np.bitwise_count(mask & ((np.uint8(1) << quarter) - np.uint8(1)))
        return np.where((mask >> quarter) & 1, self.starts[level][nodes] + before, -1)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores above 0 of the ``k`` best columns, ties to smaller columns."""
        columns, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        root = int(weights.sum()) * int(self.maxima[0][0])
        level, column, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([root], np.int64)
        nodes = np.zeros((1, len(rows)), np.int64)
        while len(bound):
            least = int(scores[-1]) if len(scores) == k else 1
            live = np.flatnonzero(bound >= least)
            if len(live) > FRONT:
                lead = np.argpartition(bound[live], -FRONT)
                now, later = live[lead[-FRONT:]], live[lead[:-FRONT]]
            else:
                now, later = live, live[:0]
            made = [(level[later], column[later], bound[later], nodes[later])]
            for at in np.unique(level[now]).tolist():
                here = now[level[now] == at]
                if at == self.height:
                    columns, scores = np.append(columns, column[here]), np.append(scores, bound[here])
                    order = np.lexsort((columns, -scores))[:k]
                    columns, scores = columns[order], scores[order]
                    continue
                for side in (0, 1):
                    child = self._children(at, nodes[here], rows, side)
                    limit = (np.where(child >= 0, self.maxima[at + 1][child], 0).astype(np.int64) * weights).sum(axis=1)
                    far = np.flatnonzero(limit >= least)
                    made.append((np.full(len(far), at + 1), 2 * column[here][far] + side, limit[far], child[far]))
            level, column, bound, nodes = (np.concatenate(parts) for parts in zip(*made))
        return columns, scores


class _Shard:
    """Terms and lengths of some documents."""

    def __init__(self) -> None:
        self.known: defaultdict[bytes, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        at, n = len(self.ids), 0
        for terms in term_runs(text):
            held = np.fromiter(map(self.known.__getitem__, terms), np.uint64, len(terms))
            self.parts.append((held << np.uint64(32)) | np.uint64(at))
            n += len(terms)
        if n:
            self.ids.append(doc_id)
            self.size += n

    def row(self, documents: int, all_terms: int) -> tuple[bytes, bytes, bytes, bytes]:
        """Terms by falling number of documents, ids (nulls last), these numbers, and the tree."""
        cells, tf = np.unique(np.concatenate(self.parts), return_counts=True)
        term, doc = (cells >> np.uint64(32)).astype(np.int64), (cells & np.uint64(0xFFFFFFFF)).astype(np.int64)
        length = np.bincount(doc, weights=tf).astype(np.int64)
        m = np.array([75 + 25 * n * documents // all_terms for n in length.tolist()], np.int64)
        held = np.bincount(term)
        by_holders = np.argsort(-held, kind="stable")
        row = np.empty(len(held), np.int64)
        row[by_holders] = np.arange(len(held))
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        column = np.empty(len(order), np.int64)
        column[order] = np.arange(len(order))
        tree = Treap.of(row[term], column[doc], impacts(tf, m[doc]))
        words = list(self.known)
        terms = b"\n".join([words[i] for i in by_holders.tolist()])
        nulls = np.int64(sum(i is None for i in self.ids)).tobytes()
        ids = nulls + np.array([self.ids[i] or 0 for i in order], np.int64).tobytes()
        return zstandard.compress(terms, 1), ids, zstandard.compress(held[by_holders].astype("<u4").tobytes(), 1), tree.packed()


@dataclass(frozen=True)
class Index:
    """``shards`` (written), the documents that have a term, and the terms of all of them with repeats."""

    shards: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Treaps over all ``docs``. Every row is a document; a null or empty text has no terms and takes no part."""
    held = id_and_text(docs, id_col, text_col).where("__text is not null")

    def lengths(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [sum(map(len, term_runs(t))) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)]), pa.array([sum(n)])], names=["documents", "terms"])

    total = batches(held.select("__text"), lengths, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, terms = total[0] or 0, total[1] or 0

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32

        def close() -> pa.RecordBatch:
            made = [[number], *([x] for x in shard.row(documents, terms))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["shard", "terms", "ids", "holders", "tree"])

        for batch in stream:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                shard.add(doc_id, text)
                if shard.size >= SHARD_TERMS or len(shard.ids) >= SHARD_DOCS:
                    yield close()
                    shard, number = _Shard(), number + 1
        if shard.ids:
            yield close()

    return Index(written(held.mapInArrow(run, SHARDS), "treaps"), documents, terms)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``q, term, n``: the terms of every distinct item and how often it has them."""
    slim = items.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("q"), as_bytes(text_col).alias("text")).where("text is not null")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, term = [], []
        for name, text in zip(*(c.to_pylist() for c in batch.columns)):
            for terms in term_runs(text):
                q += [name] * len(terms)
                term += terms
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(term, pa.binary())], names=["q", "term"])

    return batches(slim.dropDuplicates(["q"]), step, "q long, term binary").groupBy("q", "term").agg(F.count("*").alias("n"))


Asked = list[tuple[int, list[bytes], np.ndarray]]


def _met(index: Index, asked: DataFrame, groups: int, column: str, answer: Callable[[Asked, dict[str, bytes]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``answer(items, shard)`` for each shard and each group of ``asked(q, terms, weights)``; the shard has ``column`` too."""
    parts = max(1, index.shards.count())
    spread = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    heads = asked.select(F.pmod("q", F.lit(groups)).alias("grp"), spread.alias("part"), F.lit(0).alias("kind"), "q", "terms", "weights", F.lit(None).cast("binary").alias("more"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    place = F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int").alias("part")
    rows = index.shards.select(every.alias("grp"), place, F.lit(1).alias("kind"), F.col("shard").alias("q"), "terms", F.col("ids").alias("weights"), F.col(column).alias("more"))
    dealt = heads.union(rows).repartition(parts * groups, "grp", "part").sortWithinPartitions("grp", "part", "kind")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items = None, []
        for batch in stream:
            for grp, part, kind, q, terms, weights, more in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, part) != now:
                    now, items = (grp, part), []
                if kind == 0:
                    items.append((q, terms.split(b"\n"), np.frombuffer(weights, np.int64)))
                elif items:
                    made = answer(items, {"terms": terms, "ids": weights, column: more})
                    if made is not None and made.num_rows:
                        yield made

    return dealt.mapInArrow(run, schema)


def _rows_of(items: Asked, shard: dict[str, bytes]) -> dict[bytes, int]:
    wanted = {t for _, terms, _ in items for t in terms}
    return {t: i for i, t in enumerate(zstandard.decompress(shard["terms"]).split(b"\n")) if t in wanted}


def _holders(items: Asked, shard: dict[str, bytes]) -> pa.RecordBatch:
    rows = _rows_of(items, shard)
    held = np.frombuffer(zstandard.decompress(shard["holders"]), "<u4").astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(held[list(rows.values())] if rows else [], pa.int64())], names=["term", "df"])


def _best(k: int) -> Callable[[Asked, dict[str, bytes]], pa.RecordBatch]:
    def answer(items: Asked, shard: dict[str, bytes]) -> pa.RecordBatch:
        rows, tree, out = _rows_of(items, shard), Treap.unpacked(shard["tree"]), []
        stored = np.frombuffer(shard["ids"], np.int64)
        ids = [*stored[1:].tolist()]
        ids[len(ids) - int(stored[0]) :] = [None] * int(stored[0])
        for q, terms, weights in items:
            here = [i for i, t in enumerate(terms) if t in rows]
            if here:
                columns, scores = tree.best(np.array([rows[terms[i]] for i in here]), weights[here], k)
                out += [(q, ids[c], s) for c, s in zip(columns.tolist(), scores.tolist())]
        made = [pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], [], []))]
        return pa.RecordBatch.from_arrays(made, names=["q", "doc", "score"])

    return answer


def _asked(terms: DataFrame) -> DataFrame:
    """``q, terms, weights`` of ``terms(q, term, weight)``, packed a row an item."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        q, held = batch.column("q").to_pylist(), batch.column("held").to_pylist()
        words = [b"\n".join(x["term"] for x in one) for one in held]
        weights = [np.array([x["weight"] for x in one], np.int64).tobytes() for one in held]
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(words, pa.binary()), pa.array(weights, pa.binary())], names=["q", "terms", "weights"])

    grouped = terms.groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("held"))
    return batches(grouped, step, "q long, terms binary, weights binary")


def search(index: Index, items: DataFrame, k: int = BEST, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``id_col, rank, doc_id, score``: the ``k`` documents of every item with the highest scores above 0.

    Equal scores go by ascending ``doc_id``, null ids last; rows of one id are documents each. An item's repeated terms
    count as often as they stand in it. An item that repeats id and text is asked once; texts that share an id are
    ranked each on its own. Null or empty items, and an empty index, give no rows.
    """
    found = written(item_terms(items, id_col, text_col), "item-terms")
    groups = max(1, -(-found.count() // GROUP_TERMS))
    # Every term stands in one bundle, so each shard counts it once.
    bundles = found.select(F.pmod(F.xxhash64("term"), F.lit(groups)).alias("q"), "term", F.lit(0).cast("long").alias("weight")).distinct()
    held = _met(index, _asked(bundles), groups, "holders", _holders, "term binary, df long")
    df = written(held.groupBy("term").agg(F.sum("df").alias("df")), "holders")
    weight = F.floor(1000 * F.log((2 * F.lit(index.documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = written(_asked(found.join(df, "term").select("q", "term", (weight * F.col("n")).alias("weight"))), "weighted-items")
    near = _met(index, weighted, groups, "tree", _best(k), "q long, doc long, score long")
    order = W.partitionBy("q").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    named = items.select(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("q"), F.col(f"`{id_col}`").alias("__item")).dropDuplicates(["q"])
    return ranked.join(named, "q").select(F.col("__item").alias(id_col), "rank", F.col("doc").alias("doc_id"), "score")
