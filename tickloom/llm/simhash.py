"""Near-duplicate documents by 64-bit SimHash, candidates from chains of segments.

Cut two fingerprints into a ring of eight 8-bit segments. If they differ in at most three bits,
then from some segment on every chain of ``n`` consecutive segments holds at most ``3 n / 8`` of the
differences: none in the first two, one in the first three to five, two in six or seven. One
difference in segments three to five leaves two of these three equal. So such a pair agrees on 32
bits in one of 24 ways (8 starts, 3 choices), and these 32 bits are the key the fingerprints are
dealt by. Inside a key the rest of the chain is tested, then the full Hamming distance.

Only distinct fingerprints are compared. A key of more than ``SPLIT`` fingerprints is cut
further by the value of one more segment (three differences in the four segments left leave at least one
equal). Inside a group a spanning forest is built, never all pairs: small groups compare in
blocks, large ones look the possible neighbours up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import with_columns, written
from tickloom.llm.components import components

SEGMENTS = 8
MAX_BITS = 3
SPLIT = 2048  # fingerprints per key before the key is cut further
CHAIN = [MAX_BITS * n // SEGMENTS for n in range(1, SEGMENTS + 1)]


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the word shingles: a bit is set where over half of the hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[size - 1 :])]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        part = hashes[lo : lo + (1 << 14)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "__fp") -> DataFrame:
    """``docs`` and the fingerprint of each whole text as a long."""

    def compute(texts: list[bytes | None]) -> list[pa.Array]:
        made = np.array([fingerprint(t) for t in texts], np.uint64)
        return [pa.array(made.view(np.int64))]

    return with_columns(docs, text_col, compute, [T.StructField(name, T.LongType())])


def _segment(i: int) -> F.Column:
    return F.shiftrightunsigned("fp", 8 * (i % SEGMENTS)).bitwiseAND(F.lit(255).cast("long"))


def _pack(parts: list[F.Column]) -> F.Column:
    key = parts[0]
    for part in parts[1:]:
        key = F.shiftleft(key, 8).bitwiseOR(part)
    return key


def _keys() -> list[tuple[int, tuple[int, int], int]]:
    """Start, the two segments equal besides the first two, and the tag of each of the 24 ways."""
    choices = list(combinations((2, 3, 4), 2))
    return [(s, c, s * len(choices) + k) for s in range(SEGMENTS) for k, c in enumerate(choices)]


def _free(start: int, choice: tuple[int, int]) -> list[int]:
    return [(start + i) % SEGMENTS for i in range(2, SEGMENTS) if i not in choice]


def _keyed(fps: DataFrame) -> DataFrame:
    tagged = [
        F.struct(
            _pack([F.lit(tag).cast("long"), _segment(s), _segment(s + 1), _segment(s + a), _segment(s + b)]).alias("key"),
            F.lit(s).cast("int").alias("start"),
        )
        for s, (a, b), tag in _keys()
    ]
    return fps.select("fp", F.explode(F.array(*tagged)).alias("t")).select("fp", "t.key", "t.start")


def _split_hot(keyed: DataFrame) -> DataFrame:
    """Give the rows of keys above ``SPLIT`` one row for each free segment, keyed by its value too."""
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT).select("key", F.lit(True).alias("hot"))
    marked = keyed.join(hot, "key", "left")
    ways = _keys()
    # Which segments a tag leaves free.
    free = F.create_map(*[x for s, c, tag in ways for x in (F.lit(tag).cast("long"), F.array(*map(F.lit, _free(s, c))))])
    slots = F.when(F.col("hot"), F.element_at(free, F.shiftright("key", 32))).otherwise(F.array(F.lit(-1)))
    cut = marked.select("fp", "key", "start", F.explode(slots).alias("slot"))
    value = F.expr("shiftrightunsigned(fp, cast(8 * slot as int)) & 255")
    return cut.select("fp", "key", "start", "slot", F.when(F.col("slot") >= 0, value).otherwise(F.lit(-1).cast("long")).alias("sub"))


def _close(fp: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Which of ``others`` pass the chain from ``start`` and then the full distance."""
    apart = fp ^ others
    ring = np.bitwise_count(apart.view(np.uint8).reshape(-1, SEGMENTS))
    order = [(start + i) % SEGMENTS for i in range(SEGMENTS)]
    chain = np.cumsum(ring[:, order], axis=1)
    passed = np.flatnonzero((chain <= np.array(CHAIN)).all(axis=1))
    return passed[np.bitwise_count(apart[passed]) <= MAX_BITS]


def _forest(fps: np.ndarray, start: int) -> Iterator[tuple[int, int]]:
    """Edges that connect what links inside one small group, by search from node to node."""
    left = fps
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            node = stack.pop()
            near = _close(node, left, start)
            for other in left[near]:
                yield node, other
                stack.append(other)
            if len(near):
                left = np.delete(left, near)


def _flips(free: list[int]) -> np.ndarray:
    bits = [np.uint64(1) << np.uint64(8 * s + b) for s in free for b in range(8)]
    made = [np.bitwise_or.reduce(np.array(c, np.uint64)) for n in range(1, MAX_BITS + 1) for c in combinations(bits, n)]
    return np.array(made, np.uint64)


def _looked_up(fps: np.ndarray, free: list[int]) -> Iterator[tuple[int, int]]:
    """The same for a large group: the neighbours that differ in free segments are looked up."""
    flips, seen = _flips(free), np.zeros(len(fps), bool)
    for first in range(len(fps)):
        if seen[first]:
            continue
        seen[first], stack = True, [first]
        while stack:
            at = stack.pop()
            probes = fps[at] ^ flips
            spots = np.minimum(np.searchsorted(fps, probes), len(fps) - 1)
            for other in spots[fps[spots] == probes]:
                if not seen[other]:
                    seen[other] = True
                    stack.append(other)
                    yield fps[at], fps[other]


def _linked(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forest edges of every group in rows sorted by (key, slot, sub)."""
    ways = {tag: (s, c) for s, c, tag in _keys()}
    held: list[np.ndarray] = []
    label: tuple[int, int, int] | None = None

    def close() -> Iterator[pa.RecordBatch]:
        fps = np.unique(np.concatenate(held)).view(np.uint64)
        if len(fps) < 2:
            return
        start, choice = ways[label[0] >> 32]
        free = [s for s in _free(start, choice) if s != label[1]]
        found = list(_forest(fps, start) if len(fps) <= 2 * SPLIT else _looked_up(fps, free))
        if found:
            ends = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["u", "v"])

    for batch in stream:
        key, slot, sub, fp = (np.asarray(batch.column(n)) for n in ("key", "slot", "sub", "fp"))
        change = (key[1:] != key[:-1]) | (slot[1:] != slot[:-1]) | (sub[1:] != sub[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            now = (int(key[lo]), int(slot[lo]), int(sub[lo]))
            if label is not None and now != label:
                yield from close()
                held = []
            label = now
            held.append(fp[lo:hi])
    if held:
        yield from close()


def links(fps: DataFrame) -> DataFrame:
    """``u, v``: links that connect all of ``fps(fp long)`` within ``MAX_BITS`` of each other."""
    keyed = _split_hot(_keyed(fps))
    grouped = keyed.repartition("key", "slot", "sub").sortWithinPartitions("key", "slot", "sub")
    return grouped.select("key", "slot", "sub", "fp").mapInArrow(_linked, "u long, v long")


def labels(prints: DataFrame, link: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """``__fp, __group, component_id`` of every distinct fingerprint of ``prints(__fp, __sim_id)``."""
    fps = written(prints.groupBy(F.col("__fp").alias("fp")).agg(F.min("__sim_id").alias("least")), "simhash-distinct")
    roots = components(link(fps.select("fp")))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left")
    named = written(rooted.select("fp", "least", F.coalesce("root", "fp").alias("__group")), "simhash-roots")
    least = named.groupBy("__group").agg(F.min("least").alias("component_id"))
    return named.join(least, "__group").select(F.col("fp").alias("__fp"), "__group", "component_id")


def with_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__fp``, ``__group`` (a value all linked rows share) and ``component_id``.

    A null or empty text has fingerprint zero and links like any other. A null id never becomes a
    component id unless all ids of the group are null. Repeated rows all stay. An empty table gives none.
    """
    ided = docs.withColumn("__sim_id", F.col(f"`{id_col}`").cast("long"))
    marked = written(with_fingerprint(ided, text_col), "simhash")
    return marked.join(labels(marked.select("__fp", "__sim_id")), "__fp").drop("__sim_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row; cases as in ``with_component``."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("__sim_id"), F.col(f"`{text_col}`").alias("__t"))
    prints = written(with_fingerprint(slim, "__t").select("__sim_id", "__fp"), "simhash")
    hexed = F.lpad(F.lower(F.hex("__fp")), 16, "0")
    return prints.join(labels(prints), "__fp").select(
        F.col("__sim_id").alias("doc_id"), hexed.alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest id of every component, with the columns of ``docs`` (of repeated rows, one)."""
    marked = with_component(docs, id_col, text_col)
    least = marked.where(F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("component_id")))
    return least.dropDuplicates(["__group"]).select(*(F.col(f"`{c}`") for c in docs.columns))
