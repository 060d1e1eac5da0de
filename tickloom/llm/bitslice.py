"""Exact top-k inner products from a bit-sliced index.

A block of the index holds up to ``BLOCK`` vectors of whole numbers. For every attribute the
distance from the block's least value is stored as slices: one bitmap over the rows for each bit.
A query adds the slices of all attributes, each shifted by the bits of its own component, with
carry-save adders on whole bitmaps; a negative component takes the complement slices and a
constant. The result is the score of every row as slices again. From the most significant slice
down the rows are parted into surely in, out and still equal; rows still equal at the end
have the score of the last place, and the smallest ids among them are taken.

Both sides are dealt in blocks: a block of queries meets every block of the index, each pair
of blocks is one row of one task, and the best k of a pair are all that is passed on.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tickloom.llm.common import written

BLOCK = 16_384  # rows of the index in a block
QUERIES = 128  # queries in a block
SCALE = 256.0


def whole_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, dims, v``: components times 256, rounded down; rows with a null id or a null or non-finite vector are left out."""
    values = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), values.alias("v")).where("id is not null and v is not null")
    return held.where(sound).select(
        "id", F.size("v").alias("dims"), F.transform("v", lambda x: F.floor(x * SCALE).cast("long")).alias("v")
    )


def _pack(ids: np.ndarray, values: np.ndarray) -> bytes:
    out = io.BytesIO()
    widest = int(np.abs(values).max()) if values.size else 0
    kind = np.int16 if widest < 1 << 15 else np.int32 if widest < 1 << 31 else np.int64
    np.savez(out, ids=ids, values=values.astype(kind))
    return out.getvalue()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    with np.load(io.BytesIO(blob)) as held:
        return held["ids"], held["values"].astype(np.int64)


def in_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """``dims, rows``: blocks of at most ``size`` vectors of equal length, whatever partition they come from."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def close(dims: int) -> pa.RecordBatch:
            parts = held.pop(dims)
            blob = _pack(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([blob], pa.binary())], names=["dims", "rows"])

        for batch in stream:
            ids, dims = np.asarray(batch.column("id")), np.asarray(batch.column("dims"))
            column = batch.column("v")
            flat, starts = np.asarray(column.values), np.asarray(column.offsets)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                values = flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0), np.int64)
                while len(at):
                    room = size - sum(len(p[0]) for p in held.get(d, []))
                    held.setdefault(d, []).append((ids[at[:room]], values[:room]))
                    if len(at) >= room:
                        yield close(d)
                    at, values = at[room:], values[room:]
        for d in list(held):
            yield close(d)

    return vectors.mapInArrow(run, "dims int, rows binary")


class SlicedBlock:
    """The bit slices of one block; rows in the order of their ids."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, values = ids[order], values[order]
        self.words = -(-len(ids) // 64)
        self.low = values.min(axis=0)
        above = (values - self.low).astype(np.uint64)
        self.bits = [int(x).bit_length() for x in above.max(axis=0)]
        self.valid = self._bitmap(np.ones(len(ids), bool))
        self.slices = [
            np.array([self._bitmap((above[:, d] >> np.uint64(b)) & np.uint64(1)) for b in range(n)]).reshape(n, self.words)
            for d, n in enumerate(self.bits)
        ]

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.words * 8, np.uint8)
        made = np.packbits(np.asarray(flags, bool), bitorder="little")
        packed[: len(made)] = made
        return packed.view(np.uint64)

    def score_slices(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the scores above a constant, least significant first, and the constant."""
        columns: dict[int, list[np.ndarray]] = {}
        constant = 0
        for d, x in enumerate(query.tolist()):
            constant += x * int(self.low[d])
            part = self.slices[d]
            if x < 0:
                constant += x * ((1 << self.bits[d]) - 1)
                part = ~part
            for j in range(abs(x).bit_length()):
                if abs(x) >> j & 1:
                    for b in range(self.bits[d]):
                        columns.setdefault(j + b, []).append(part[b])
        return self._added(columns), constant

    def _added(self, columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
        """Carry-save addition: three bitmaps of one weight become one of it and one of the next."""
        out, weight = [], 0
        waiting = {w: np.array(maps) for w, maps in columns.items()}
        while waiting and weight <= max(waiting):
            maps = waiting.pop(weight, np.zeros((0, self.words), np.uint64))
            carries = []
            while len(maps) > 1:
                third = max(len(maps) // 3, 1)
                a, b = maps[:third], maps[third : 2 * third]
                c = maps[2 * third : 3 * third] if len(maps) > 2 else np.zeros_like(a)
                both = a ^ b
                carries.append((a & b) | (both & c))
                maps = np.concatenate([both ^ c, maps[3 * third :]])
            if carries:
                more = [waiting[weight + 1]] if weight + 1 in waiting else []
                waiting[weight + 1] = np.concatenate(more + carries)
            out.append(maps[0] if len(maps) else np.zeros(self.words, np.uint64))
            weight += 1
        return out

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's id."""
        slices, constant = self.score_slices(query)
        equal = self.valid.copy()
        for row in range(*np.searchsorted(self.ids, [query_id, query_id + 1])):
            equal[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        inside = np.zeros_like(equal)
        for bit in reversed(slices):
            tried = inside | (equal & bit)
            n = int(np.bitwise_count(tried).sum())
            if n > k:
                equal &= bit
            else:
                inside, equal = tried, equal & ~bit
                if n == k:
                    break
        sure = self._rows(inside)
        rows = np.concatenate([sure, self._rows(equal)[: max(k - len(sure), 0)]])
        scores = np.full(len(rows), constant, np.int64)
        for b, bit in enumerate(slices):
            on = (bit[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
            scores += on.astype(np.int64) << b
        return self.ids[rows], scores

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        spots = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[spots].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        word, bit = np.nonzero(bits)
        return spots[word] * 64 + bit


def top_products(
    queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERIES
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of ``vectors`` for each of ``queries`` (both ``id, dims, v``).

    Rows with the query's id are never its candidates. Vectors meet those of their own length only;
    a length of zero scores 0. Components are whole numbers whose scores fit 64 bits. Repeated rows are
    candidates each; a repeated query is asked once, two vectors under one id are two queries with one id.
    """
    asked = written(in_blocks(queries.distinct(), query_block), "query-blocks")
    index = written(in_blocks(vectors, block), "index-blocks")
    # A block of the index lies in one place, and every block of queries, of which there are fewer, comes to all places.
    parts = max(1, index.count())
    place = F.pmod(F.xxhash64("rows"), F.lit(parts)).cast("int")
    stored = index.select("dims", place.alias("part"), F.lit(0).alias("kind"), "rows")
    coming = asked.select("dims", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "rows")
    dealt = stored.union(coming).repartition(parts, "dims", "part").sortWithinPartitions("dims", "part", "kind")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in stream:
            for dims, part, kind, rows in zip(*(batch.column(n).to_pylist() for n in ("dims", "part", "kind", "rows"))):
                if (dims, part) != now:
                    now, held = (dims, part), []
                if kind == 0:
                    held.append(SlicedBlock(*_unpack(rows)))
                    continue
                out = []
                for query_id, query in zip(*_unpack(rows)) if held else ():
                    tag = xxhash.xxh64_intdigest(query.tobytes()) >> 1
                    for sliced in held:
                        ids, scores = sliced.top(int(query_id), query, k)
                        out += [(int(query_id), tag, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*out)], names=["query_id", "tag", "vec_id", "score"]
                    )

    found = dealt.mapInArrow(run, "query_id long, tag long, vec_id long, score long")
    order = W.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
