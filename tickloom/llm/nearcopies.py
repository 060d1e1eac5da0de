"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Candidates come from SimHash first, as in operator 7: 64-bit fingerprints of the shingle sets, dealt by chains of segments, that differ in
at most ``simhash.MAX_BITS`` bits. Most pairs at 0.8 differ in more (README has the share), so the rest
come from MinHash: ``BANDS`` bands of ``ROWS`` least values. A pair of similarity s shares a band with
probability 1 - (1 - s^5)^30: all but 7 in a million at 0.8, fewer above. A link is a pair whose whole sets were compared and are
at least ``SIMILARITY`` alike; only links are closed to groups.

* Sets of linked fingerprints are compared, each fingerprint's least set with the others of it and with those next to it.
* Then every member of a band is compared with the band's least member, if it was not yet. That joins up true groups of any size.
* Bands that still hold several groups are cut into blocks of about ``MEMBERS``; each pair of blocks meets in one task, where
  members of different groups are compared by their signatures. Those with a pair whose estimate reaches ``LEAST_ESTIMATE`` (a pair at
  a true 0.8 misses it 2 times in a million) meet there once more with their texts; such pairs are compared as whole sets, unless
  links found before join them already. A pair meets in its first common band only.

So no task holds more than two blocks of members, or one set and a stream of others. Texts stay where they are until the
rows to compare, and at the end the rows to keep, are fetched by key. Only distinct shingle sets take part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import simhash
from tickloom.llm.common import batches, released, written
from tickloom.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 30
LEAST_ESTIMATE = 0.65
MEMBERS = 1024  # of a block, or compared with one set in a task
BLOCK = 512  # shingles hashed at once

_random = np.random.default_rng(20)
_FLIP = _random.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64, endpoint=False)
_TIMES = _random.integers(0, 1 << 64, (ROWS * BANDS, 1), np.uint64, endpoint=False) | np.uint64(1)
_PLACE = _random.integers(0, 1 << 64, max(SHINGLE, ROWS), np.uint64, endpoint=False) | np.uint64(1)


def _mixed(values: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(33))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct five-word shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size, digest = min(SHINGLE, len(words)), xxhash.xxh64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    made = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        made = made + hashes[i : i + len(made)] * _PLACE[i]
    return np.unique(_mixed(made))


def least_values(held: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the ``ROWS * BANDS`` hashes."""
    made = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(held), BLOCK):
        np.minimum(made, ((held[lo : lo + BLOCK] ^ _FLIP) * _TIMES).min(axis=1), out=made)
    return made


def signature(held: np.ndarray) -> bytes:
    """The least values, cut to 32 bits; nothing for an empty set."""
    return least_values(held).astype("<u4").tobytes() if len(held) else b""


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """A name of every band of every signature."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return _mixed((_mixed(rows) * _PLACE[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def signed(keyed: DataFrame) -> DataFrame:
    """``id, tag, fp, print, sig`` of ``keyed(id, tag, text)``: ``fp`` names the shingle set (0 for none), ``print`` is its SimHash."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        names = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64)
        prints = np.array([simhash.majority(s) for s in sets], np.uint64)
        columns = [batch.column("id"), batch.column("tag"), pa.array(names.view(np.int64)), pa.array(prints.view(np.int64))]
        columns.append(pa.array([signature(s) for s in sets], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=["id", "tag", "fp", "print", "sig"])

    return batches(keyed, step, "id long, tag long, fp long, print long, sig binary")


def print_pairs(sets: DataFrame) -> DataFrame:
    """``u, v``: candidates of ``sets(fp, print)`` by SimHash. Equal fingerprints meet their least set, linked ones by their least sets."""
    prints = written(sets.where("fp != 0").groupBy("print").agg(F.min("fp").alias("hub")), "near-prints")
    own = sets.where("fp != 0").select("fp", "print").join(prints, "print").where("fp != hub").select(F.col("fp").alias("u"), F.col("hub").alias("v"))
    found = simhash.links(prints.select(F.col("print").alias("fp"))).distinct()
    one, other = (prints.select(F.col("print").alias(c), F.col("hub").alias(f"hub_{c}")) for c in ("u", "v"))
    linked = found.join(one, "u").join(other, "v").select(F.greatest("hub_u", "hub_v").alias("u"), F.least("hub_u", "hub_v").alias("v"))
    return own.union(linked).distinct()


def banded(sets: DataFrame) -> DataFrame:
    """``fp, band`` of ``sets(fp, sig)``, a row for each band."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        held = [(fp, sig) for fp, sig in zip(batch.column("fp").to_pylist(), batch.column("sig").to_pylist()) if sig]
        if not held:
            return None
        values = bands_of(np.frombuffer(b"".join(sig for _, sig in held), "<u4"))
        fps = np.repeat(np.array([fp for fp, _ in held], np.int64), BANDS)
        return pa.RecordBatch.from_arrays([pa.array(fps), pa.array(values.ravel().view(np.int64))], names=["fp", "band"])

    return batches(sets.select("fp", "sig"), step, "fp long, band long")


def is_similar(one: np.ndarray, other: np.ndarray) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common >= SIMILARITY * (len(one) + len(other) - common) - 1e-9


def fetched(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Columns of ``docs(id, tag, ...)`` and of ``keys(k_id, k_tag, many, ...)``: one row for each key; ``many`` says that several rows have it."""
    met = docs.join(keys, docs["id"].eqNullSafe(keys["k_id"]) & (docs["tag"] == keys["k_tag"]))
    if keys.where("many").isEmpty():
        return met
    repeated = [c for c in keys.columns if c != "many"]
    return met.where("not many").unionByName(met.where("many").dropDuplicates(repeated))


def similar_pairs(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose whole sets are similar; ``sets(fp, id, tag, many)`` says where a set's text is.

    A task streams the texts of ``v`` past one ``u``; a ``u`` of many pairs is met in several tasks.
    """
    parts = pairs.groupBy(F.col("v").alias("fp")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    heads = parts.select("fp", F.col("fp").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"))
    cut = pairs.join(parts.withColumnRenamed("fp", "v"), "v")
    members = cut.select(F.col("u").alias("fp"), F.col("v").alias("hub"), F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"))
    roles = heads.union(members)
    needed = sets.join(roles.select("fp").distinct(), "fp").select("fp", F.col("id").alias("k_id"), F.col("tag").alias("k_tag"), "many")
    texts = fetched(docs, needed).select("fp", "text")
    dealt = texts.join(roles, "fp").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", "fp")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, np.zeros(0, np.uint64)
        for batch in stream:
            found = []
            for fp, at, kind, text in zip(*(batch.column(c).to_pylist() for c in ("fp", "hub", "kind", "text"))):
                if kind == 0:
                    hub, held = at, shingles(text)
                elif hub == at and is_similar(held, shingles(text)):
                    found.append((fp, at))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    return dealt.select("fp", "hub", "kind", "text").mapInArrow(run, "u long, v long")


def _likely(labels: np.ndarray, side: np.ndarray, signatures: np.ndarray, band: int, within: bool) -> Iterator[tuple[int, int]]:
    """Pairs of different groups, from two blocks or inside one, that may be similar and share no band before ``band``."""
    names = bands_of(signatures)
    for i in range(len(labels)):
        others = np.flatnonzero((labels != labels[i]) & ((np.arange(len(labels)) > i) if within else (side > side[i])))
        others = others[(signatures[others] == signatures[i]).mean(axis=1) >= LEAST_ESTIMATE]
        shared = names[others] == names[i]
        for j, row in zip(others.tolist(), shared):
            if names[j][row.argmax()].view(np.int64) == band:
                yield i, j


PLACE = ["band", "first", "second"]


def _by_place(members: DataFrame, settle: Callable[[tuple, list[tuple]], Iterator[pa.RecordBatch]], columns: list[str], schema: str) -> DataFrame:
    """``settle(place, rows)`` for the ``columns`` of all members of each pair of blocks."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in stream:
            for row in zip(*(batch.column(c).to_pylist() for c in [*PLACE, *columns])):
                if row[:3] != now:
                    if len(held) > 1:
                        yield from settle(now, held)
                    now, held = row[:3], []
                held.append(row[3:])
        if len(held) > 1:
            yield from settle(now, held)

    return members.repartition(*PLACE).sortWithinPartitions(*PLACE).mapInArrow(run, schema)


def _arrays(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    block, fp, label = (np.array(c, np.int64) for c in list(zip(*rows))[:3])
    return block, fp, label, np.frombuffer(b"".join(r[3] for r in rows), "<u4").reshape(len(rows), -1)


def likely_members(members: DataFrame) -> DataFrame:
    """``members(band, first, second, block, fp, label, sig)`` that may be similar to one of another group in the same place."""

    def settle(place: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        block, fp, label, signatures = _arrays(rows)
        chosen = sorted({i for pair in _likely(label, block, signatures, place[0], place[1] == place[2]) for i in pair})
        if chosen:
            size = len(chosen)
            columns = [pa.array([place[0]] * size, pa.int64()), *(pa.array([x] * size, pa.int32()) for x in place[1:]), pa.array(block[chosen], pa.int32())]
            columns += [pa.array(fp[chosen]), pa.array(label[chosen]), pa.array([rows[i][3] for i in chosen], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*PLACE, "block", "fp", "label", "sig"])

    schema = "band long, first int, second int, block int, fp long, label long, sig binary"
    return _by_place(members, settle, ["block", "fp", "label", "sig"], schema)


def joined_members(members: DataFrame) -> DataFrame:
    """``u, v``: links that join the groups of ``members``, which have their ``text`` too; pairs that are joined already are not compared."""

    def settle(place: tuple, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        block, fp, label, signatures = _arrays(rows)
        held = [shingles(r[4]) for r in rows]
        above = {int(x): int(x) for x in label}

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        found = []
        for i, j in _likely(label, block, signatures, place[0], place[1] == place[2]):
            one, other = root(int(label[i])), root(int(label[j]))
            if one != other and is_similar(held[i], held[j]):
                above[one] = other
                found.append((int(fp[i]), int(fp[j])))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    return _by_place(members, settle, ["block", "fp", "label", "sig", "text"], "u long, v long")


def _in_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` for ``likely_pairs`` from ``rows(band, fp, label)``: a member goes to every pair of blocks that has its own."""
    counts = rows.groupBy("band").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    own = rows.join(counts, "band").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = met.select("band", "block", "fp", "label", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    return placed.join(sets.select("fp", "sig"), "fp")


def links(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``u, v``: links that connect all similar sets of ``sets(fp, id, tag, many, print, sig)``, whose texts are in ``docs(id, tag, text)``."""
    prints = written(print_pairs(sets), "near-print-pairs")
    released(sets.sparkSession)
    close = written(similar_pairs(prints, sets, docs), "near-print-links")
    spread = written(banded(sets), "near-bands")
    shared = written(spread.groupBy("band").agg(F.min("fp").alias("hub"), F.max("fp").alias("last")).where("hub != last"), "near-shared")
    members = written(spread.join(shared.select("band", "hub"), "band"), "near-members")
    met = members.where("fp != hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    tried = written(met.join(prints, ["u", "v"], "left_anti"), "near-stars")
    stars = close.union(written(similar_pairs(tried, sets, docs), "near-links"))
    roots = components(stars)
    named = members.join(roots, members["fp"] == roots["node"], "left").select("band", "fp", F.coalesce("root", "fp").alias("label"))
    open_bands = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("band")
    left = written(named.join(open_bands, "band", "left_semi"), "near-open")
    likely = written(likely_members(_in_blocks(left, sets)), "near-likely")
    if likely.isEmpty():
        return stars
    needed = sets.join(likely.select("fp").distinct(), "fp").select("fp", F.col("id").alias("k_id"), F.col("tag").alias("k_tag"), "many")
    texts = fetched(docs, needed).select("fp", "text")
    return stars.union(written(joined_members(likely.join(texts, "fp")), "near-more-links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of the smallest id of every group of near copies, with the columns of ``docs`` (of repeated rows, one).

    Groups are the connected components of similarity 0.8. Texts without words form one group. A null id
    stays only where all ids of the group are null; of rows of one id, the text of the smaller hash stays. An empty table gives none.
    ``docs`` is read several times.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    at = dict(zip(docs.columns, names))
    keyed = own.withColumn("id", own[at[id_col]].cast("long")).withColumn("text", own[at[text_col]].cast("string").cast("binary"))
    keyed = keyed.withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(b""))))
    texts = keyed.select("id", "tag", "text")
    slim = written(signed(texts), "near-signatures")
    rows = slim.groupBy("fp", "id", "tag").agg(F.count("*").alias("n"), F.min("print").alias("print"), F.min("sig").alias("sig"))
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag", (F.col("n") > 1).alias("many"), "print", "sig")).alias("lead")
    sets = written(rows.groupBy("fp").agg(lead).select("fp", "lead.*"), "near-sets")
    roots = components(links(sets, texts))
    grouped = sets.join(roots, sets["fp"] == roots["node"], "left").withColumn("group", F.coalesce("root", "fp"))
    first = grouped.groupBy("group").agg(F.min(F.struct("none", "id", "tag", "many")).alias("lead"))
    keys = written(first.select(F.col("lead.id").alias("k_id"), F.col("lead.tag").alias("k_tag"), F.col("lead.many").alias("many")), "near-kept")
    return fetched(keyed.drop("text"), keys).select(*names).toDF(*docs.columns)
