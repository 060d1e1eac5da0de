"""Removal of repeated phrases, located by sharded Aho-Corasick automata.

1. Confirm. Every window of 35 words holds the seed phrase of its run (see ``repeats``). Seeds are counted
   over all documents; those that occur again are the phrases to look for.
2. Compile. Documents are dealt into shards of bounded size. Each shard is told which confirmed phrases
   concern it and compiles an automaton of these, so automata stay small whatever the corpus
   holds, and every document is streamed once.
3. Stream. The automaton locates every occurrence of its phrases in the shard's documents.
4. Check. Windows around located phrases are ranked exactly by their whole word sequence, over all
   shards, and those that start anywhere else as well are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import names
from tickloom.llm.common import released, written
from tickloom.llm.names import TILE, Named, Powers, byte_values, mix
from tickloom.llm.repeats import WINDOW, Sequence, remove_repeats, runs_of_all, with_identity

SHARD_BYTES = 4_000_000
SEED = [("name", "u8")]
ROUTE = [("name", "u8"), ("shard", "u4")]


SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of every word."""
    space = np.concatenate([[True], SPACE[np.frombuffer(text, np.uint8)], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_names(text: bytes, table: np.ndarray, powers: Powers, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """A name for every word from its bytes, a tile of words at a time; a word longer than a tile is hashed whole."""
    starts, ends = bounds or word_bounds(text)
    raw, made, at = np.frombuffer(text, np.uint8), np.zeros(len(starts), np.uint64), 0
    while at < len(starts):
        lo = int(starts[at])
        stop = int(np.searchsorted(ends, lo + TILE, side="right"))
        if stop > at:
            named = Named(table[raw[lo : ends[stop - 1]]], powers)
            made[at:stop] = named.at(starts[at:stop] - lo, ends[at:stop] - lo)
        else:
            stop = at + 1
            made[at] = xxhash.xxh64_intdigest(text[lo : ends[at]])
        at = stop
    return mix(made + mix((ends - starts).astype(np.uint64), 1), 2)


class WordWindows(Sequence):
    """Texts as words between ASCII white space; every occurrence of a repeated window is removed."""

    keep_first = False

    def __init__(self, window: int = 35, seed: int = 8) -> None:
        self.window, self.seed = window, min(seed, window)
        self.tables: tuple[np.ndarray, Powers] | None = None  # made where it is used

    def values(self, text: bytes) -> np.ndarray:
        if self.tables is None:
            self.tables = byte_values(), Powers()
        return word_names(text, *self.tables)

    def values_of_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.tables is None:
            self.tables = byte_values(), Powers()
        line = b" ".join(texts)
        bounds = word_bounds(line)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return word_names(line, *self.tables, bounds), np.searchsorted(bounds[0], begins)

    def size(self, text: bytes) -> int:
        return len(text.split())

    def kept(self, text: bytes, keep: np.ndarray) -> bytes:
        words = text.split()
        return b" ".join(words) if keep.all() else b" ".join([w for w, k in zip(words, keep.tolist()) if k])


def _seed_entries(rule: WordWindows, column: str):
    """Seeds of the runs of every document, with nothing else (``n``) or with the document's shard."""
    powers: list[Powers] = []

    def entries(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        if not powers:
            powers.append(Powers())
        shard = np.asarray(batch.column("__shard"))
        for run in runs_of_all([t or b"" for t in batch.column("__text").to_pylist()], rule, powers[0]):
            name = run["full"]
            zero = np.zeros(len(name), np.int64)
            more = {"shard": shard[run["doc"]]} if column == "shard" else {"id": zero, "tag": zero, "at": zero, "n": zero + 1}
            yield {"name": name, "deal_by": name} | more

    return entries


def _recurring(parts: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], int]:
    held = names.merged(names.joined(parts, WINDOW), "name")
    held = names.taken(held, np.flatnonzero(held["n"] > 1))
    return names.taken(held, np.argsort(held["name"], kind="stable")), int(held["n"].sum())


def _routed(entries: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    spot = np.minimum(np.searchsorted(known["name"], entries["name"]), len(known["name"]) - 1)
    rows = np.flatnonzero(known["name"][spot] == entries["name"])
    if not len(rows):
        return None
    rows = rows[np.lexsort((entries["name"][rows], entries["shard"][rows]))]
    shard, name = entries["shard"][rows].astype(np.int64), entries["name"][rows]
    fresh = np.concatenate([[True], (shard[1:] != shard[:-1]) | (name[1:] != name[:-1])])
    shard, name = shard[fresh], name[fresh]
    cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]]))
    packed = [name[lo:hi].tobytes() for lo, hi in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), pa.array(packed, pa.binary())], names=["__shard", "phrases"])


def automaton_of(phrases: set[bytes]) -> ahocorasick.Automaton:
    """An automaton over Latin-1 readings of the phrases' bytes; each yields its length."""
    made = ahocorasick.Automaton()
    for phrase in phrases:
        made.add_word(phrase.decode("latin-1"), len(phrase))
    made.make_automaton()
    return made


def located(texts: list[bytes | None], wanted: np.ndarray, rule: WordWindows, powers: Powers) -> list[bytes]:
    """For every text the places (u4) of the first words of all occurrences of the shard's phrases.

    ``wanted``: sorted names of the confirmed phrases that concern the shard; their words are taken from the texts.
    """
    held = [t or b"" for t in texts]
    phrases: set[bytes] = set()
    for run in runs_of_all(held, rule, powers) if len(wanted) else ():
        spot = np.minimum(np.searchsorted(wanted, run["full"]), len(wanted) - 1)
        rows = np.flatnonzero(wanted[spot] == run["full"])
        # Equal names are equal phrases: one place of each is read.
        rows = rows[np.unique(run["full"][rows], return_index=True)[1]]
        doc, words = -1, []
        for i in np.sort(rows).tolist():
            if run["doc"][i] != doc:
                doc = int(run["doc"][i])
                words = held[doc].split()
            at = int(run["spot"][i])
            phrases.add(b" %b " % b" ".join(words[at : at + rule.seed]))
    if not phrases:
        return [b""] * len(texts)
    automaton, out = automaton_of(phrases), []
    for text in held:
        words = text.split()
        if len(words) < rule.window:
            out.append(b"")
            continue
        line = b" %b " % b" ".join(words)
        # A match begins at the space before its first word, and the n-th space stands before the n-th word.
        found = np.array([end - size + 1 for end, size in automaton.iter(line.decode("latin-1"))], np.int64)
        if not len(found):
            out.append(b"")
            continue
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        out.append(np.unique(np.searchsorted(spaces, found)).astype(np.uint32).tobytes())
    return out


def _streamed(docs: DataFrame, routes: DataFrame, rule: WordWindows) -> DataFrame:
    """``docs`` with ``__spots``: a shard's phrases come first, then its documents, held a few megabytes at a time."""
    fields = [f for f in docs.schema.fields if f.name != "__shard"]
    schema = T.StructType([*fields, T.StructField("__spots", T.BinaryType())])
    kept = [f.name for f in fields]
    heads = routes.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields), "__shard", F.lit(0).alias("kind"), "phrases")
    rows = docs.select(*kept, "__shard", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("phrases"))
    ordered = heads.union(rows).repartition("__shard").sortWithinPartitions("__shard", "kind")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        now, names_of, held, size = None, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            wanted = np.unique(np.concatenate(names_of)) if names_of else np.zeros(0, np.uint64)
            texts = [t for part in held for t in part.column("__text").to_pylist()]
            spots = located(texts, wanted, rule, powers)
            at = 0
            for part in held:
                own = pa.array(spots[at : at + part.num_rows], pa.binary())
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), own], names=[*kept, "__spots"])

        for batch in stream:
            shards, kinds = np.asarray(batch.column("__shard")), np.asarray(batch.column("kind"))
            cuts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if shards[lo] != now:
                    if held:
                        yield from close()
                    now, names_of, held, size = shards[lo], [], [], 0
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    names_of += [np.frombuffer(p, np.uint64) for p in part.column("phrases").to_pylist()]
                else:
                    held.append(part)
                    size += part.column("__text").nbytes
                    if size >= 2 * SHARD_BYTES:
                        yield from close()
                        held, size = [], 0
        if held:
            yield from close()

    return ordered.mapInArrow(run, schema)


def with_located_phrases(docs: DataFrame, rule: WordWindows) -> DataFrame:
    """``docs(__rest, __text, __id, __tag)`` with ``__spots``, the places of all confirmed phrases."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("__text").cast("double"))).first()[0] or 0.0
    shards = max(1, int(-(-size // SHARD_BYTES)))
    dealt_docs = docs.withColumn("__shard", F.pmod(F.xxhash64("__id", "__tag"), F.lit(shards).cast("long")))
    slim = dealt_docs.select("__text", "__shard")
    buckets = names.bucket_count(size / 6 * 2 / (rule.window - rule.seed + 2))
    counted = names.deal(slim, _seed_entries(rule, "n"), WINDOW, buckets, merge_by="name")
    confirmed = written(names.by_bucket(counted, _recurring, WINDOW, SEED), "confirmed-phrases")
    released(spark)
    salts = names.salts_of(confirmed)
    dealt = names.deal(slim, _seed_entries(rule, "shard"), ROUTE, buckets, salts=salts)
    routes = names.looked_up(dealt, confirmed, salts, ROUTE, SEED, _routed, "__shard long, phrases binary")
    made = written(_streamed(dealt_docs, routes, rule), "located-phrases")
    released(spark)
    return made


def cut_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, seed: int = 8) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row.

    Null and empty texts have no words; texts of fewer words than the window stay whole. Every row is a document:
    repeated rows repeat each other's windows. Words are bytes between ASCII white space, unchanged.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rule = WordWindows(window, seed)
    done = remove_repeats(with_located_phrases(with_identity(slim, "doc_id", "text"), rule), rule)
    return done.select(F.col("__rest.c0").alias("doc_id"), F.col("n_units").alias("n_words"), "n_removed", "kept_sha256")
