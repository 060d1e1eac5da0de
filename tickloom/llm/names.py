"""Names of stretches of long sequences, and tables of names dealt over Spark in packed rows.

A stretch of units (bytes or words) is named by a 64-bit polynomial of the units' random values.
Prefix sums give the name of any stretch of a document in constant time, and the name of a
stretch of length ``2 h`` is made from those of its two halves.

Names travel in packed rows: ``bucket, salt, kind, blob``, where a blob holds some thousand entries
of fixed columns. A task merges equal names before it deals them, so a name that many rows
share reaches its bucket once a task and not once a row. A bucket that still holds far
more entries than the mean is cut by a salt when entries are looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
TILE = 1 << 20  # units that are named at a time
FLUSH = 1 << 19  # entries that a task merges before it deals them
BLOB = 1 << 13  # entries of a packed row at most
PER_BUCKET = 1_000_000  # entries meant for a bucket
LEAST_BUCKETS = 64  # a document meets at most so many buckets until the corpus needs more
PACKED = "bucket long, salt int, kind int, blob binary"


def mix(x: np.ndarray, turn: int = 0) -> np.ndarray:
    """Spreads the bits of names; each ``turn`` gives another function."""
    x = x ^ (x >> np.uint64(32 + turn))
    x = x * np.uint64(0xD6E8FEB86659FD93 + 2 * turn)
    return x ^ (x >> np.uint64(29))


def byte_values() -> np.ndarray:
    """A fixed odd random value for every byte."""
    return np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of the base and of its inverse, modulo 2**64."""

    def __init__(self, base: int = BASE) -> None:
        self.up = self._powers(base)
        self.down = self._powers(pow(base, -1, 1 << 64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        made = np.full(TILE + 1, base, np.uint64)
        made[0] = 1
        return np.cumprod(made, dtype=np.uint64)


class Named:
    """Prefix sums of one tile of a sequence."""

    def __init__(self, values: np.ndarray, powers: Powers) -> None:
        self.powers = powers
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers.down[: len(values)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Names of the stretches; equal stretches have equal names wherever they stand."""
        return (self.sums[ends] - self.sums[starts]) * self.powers.up[starts]

    def every(self, size: int) -> np.ndarray:
        """Names of all stretches of one size."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:-size]) * self.powers.up[:n] if n > 0 else np.zeros(0, np.uint64)


def doubled(half: np.ndarray, offset: int, turn: int = 0) -> np.ndarray:
    """Names of twice the length: the pair of the name at a place and the name ``offset`` further on."""
    return mix(half[:-offset] * np.uint64(BASE) + mix(half[offset:], turn + 1), turn)


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """Least value of every run of ``size`` neighbours."""
    made, step = values, 1
    while 2 * step <= size:
        made = np.minimum(made[:-step], made[step:])
        step *= 2
    return np.minimum(made[: len(values) - size + 1], made[size - step :]) if step < size else made


# Packed columns of one entry, by name and type. ``id, tag, at``: the document, its text and the start of the stretch.
Layout = list[tuple[str, str]]


def pack(columns: dict[str, np.ndarray], layout: Layout) -> bytes:
    """Columns one after the other, bytes of equal weight together, compressed; starts as differences.

    Entries stay in the order of their documents, so all but the names take little room.
    """
    parts = []
    for name, kind in layout:
        values = columns[name].astype(kind)
        if name == "at":
            values = np.diff(values, prepend=values[:0].dtype.type(0))
        parts.append(values if name in ("g", "name") else np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T))
    return len(columns[layout[0][0]]).to_bytes(8, "little") + zstandard.compress(b"".join(p.tobytes() for p in parts), 1)


def unpack(blob: bytes, layout: Layout) -> dict[str, np.ndarray]:
    n, raw, at, out = int.from_bytes(blob[:8], "little"), zstandard.decompress(blob[8:]), 0, {}
    for name, kind in layout:
        width = np.dtype(kind).itemsize
        held = np.frombuffer(raw, np.uint8, n * width, at)
        at += n * width
        out[name] = (held if name in ("g", "name") else np.ascontiguousarray(held.reshape(width, n).T).ravel()).view(kind)
        if name == "at":
            out[name] = np.cumsum(out[name], dtype=kind)
    return out


def joined(parts: list[dict[str, np.ndarray]], layout: Layout) -> dict[str, np.ndarray]:
    return {name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, kind) for name, kind in layout}


def taken(columns: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {name: values[rows] for name, values in columns.items()}


def merged(entries: dict[str, np.ndarray], name: str) -> dict[str, np.ndarray]:
    """One entry for each value of ``name``: the one of the first (id, tag, at), with the sum of ``n``; order is kept."""
    order = np.argsort(entries[name], kind="stable")
    values = entries[name][order]
    first = np.ones(len(order), bool)
    first[1:] = values[1:] != values[:-1]
    if first.all():
        return entries
    group = np.cumsum(first) - 1
    total = np.bincount(group, weights=entries["n"][order]).astype(np.int64)
    several = np.flatnonzero(np.bincount(group)[group] > 1)
    rows = order[several]
    ranked = several[np.lexsort((entries["at"][rows], entries["tag"][rows], entries["id"][rows], group[several]))]
    lead = np.flatnonzero(first)
    opens = np.ones(len(ranked), bool)
    opens[1:] = group[ranked][1:] != group[ranked][:-1]
    lead[group[ranked[opens]]] = ranked[opens]
    chosen = order[lead]
    back = np.argsort(chosen)
    out = taken(entries, chosen[back])
    out["n"] = total[back]
    return out


def same_place(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> np.ndarray:
    return (left["id"] == right["id"]) & (left["tag"] == right["tag"]) & (left["at"] == right["at"])


def bucket_count(entries: float) -> int:
    return max(LEAST_BUCKETS, int(-(-entries // PER_BUCKET)))


def deal(
    docs: DataFrame,
    entries: Callable[[pa.RecordBatch], Iterator[dict[str, np.ndarray]]],
    layout: Layout,
    buckets: int,
    merge_by: str | None = None,
    salts: dict[int, int] | None = None,
) -> DataFrame:
    """Packed rows of what ``entries`` makes of every batch; its column ``deal_by`` chooses the bucket.

    With ``merge_by`` equal values of that column are merged in the task first. ``salts``: into how many parts
    a bucket is cut.
    """
    whole = [*layout, ("deal_by", "u8")]

    def rows(held: list[dict[str, np.ndarray]], turn: int) -> Iterator[pa.RecordBatch]:
        made = joined(held, whole)
        if merge_by:
            made = merged(made, merge_by)
        place = (mix(made["deal_by"], 3) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        made, place = taken(made, order), place[order]
        bounds = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        out: list[tuple[int, int, int, bytes]] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            bucket = int(place[lo])
            for at in range(lo, hi, BLOB):
                cut = slice(at, min(at + BLOB, hi))
                salt = (turn + at) % (salts or {}).get(bucket, 1)
                out.append((bucket, salt, 1, pack({n: made[n][cut] for n, _ in layout}, layout)))
        for at in range(0, len(out), 64):
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            columns = zip(*out[at : at + 64])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "salt", "kind", "blob"])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for batch in stream:
            for part in entries(batch):
                held.append(part)
                size += len(part["deal_by"])
                if size >= FLUSH:
                    yield from rows(held, turn)
                    held, size, turn = [], 0, turn + 1
        if size:
            yield from rows(held, turn)

    return docs.mapInArrow(run, PACKED)


def by_bucket(
    packed: DataFrame, settle: Callable[[list[dict[str, np.ndarray]]], tuple[dict[str, np.ndarray], int]], layout: Layout, out: Layout
) -> DataFrame:
    """One packed row (``kind`` 0) for each bucket, from all its entries, and ``total``, a measure that ``settle`` gives."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        now: int | None = None

        def close() -> Iterator[pa.RecordBatch]:
            made, total = settle(held)
            if len(made[out[0][0]]):
                arrays = [pa.array([now], pa.int64()), pa.array([pack(made, out)], pa.binary()), pa.array([total], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "blob", "total"])

        for batch in stream:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != now and held:
                    yield from close()
                    held = []
                now = bucket
                held.append(unpack(blob, layout))
        if held:
            yield from close()

    ordered = packed.select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "bucket long, blob binary, total long")


def salts_of(settled: DataFrame, factor: int = 4, most: int = 10_000) -> dict[int, int]:
    """Buckets with more than ``factor`` times the mean of ``total``, and the parts to cut them into.

    At most one bucket in ``factor`` can be so; the ``most`` largest are cut, which bounds what the driver gets.
    """
    mean = settled.agg(F.avg("total")).first()[0]
    if not mean:
        return {}
    hot = settled.where(F.col("total") > factor * mean).select("bucket", "total").orderBy(F.desc("total")).limit(most)
    return {r["bucket"]: int(r["total"] // mean) + 1 for r in hot.collect()}


def looked_up(
    packed: DataFrame,
    settled: DataFrame,
    salts: dict[int, int],
    layout: Layout,
    settled_layout: Layout,
    found: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], pa.RecordBatch | None],
    schema: str,
) -> DataFrame:
    """``found(entries, settled entries of their bucket)`` over all packed rows, one packed row at a time."""
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in salts.items() for x in kv])[F.col("bucket")], F.lit(1)) if salts else F.lit(1)
    copies = settled.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select(
        "bucket", F.col("salt").cast("int").alias("salt"), F.lit(0).alias("kind"), "blob"
    )
    both = copies.union(packed.select("bucket", "salt", "kind", "blob"))
    ordered = both.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, known = None, None
        for batch in stream:
            columns = [batch.column(n) for n in ("bucket", "salt", "kind", "blob")]
            for i in range(batch.num_rows):
                bucket, salt, kind = (c[i].as_py() for c in columns[:3])
                if kind == 0:
                    place, known = (bucket, salt), unpack(columns[3][i].as_py(), settled_layout)
                elif place == (bucket, salt):
                    made = found(unpack(columns[3][i].as_py(), layout), known)
                    if made is not None and made.num_rows:
                        yield made

    return ordered.mapInArrow(run, schema)
