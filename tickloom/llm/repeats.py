"""Windows of documents that occur again: sparse positions, ranks of growing length, removal.

A window is a fixed number of consecutive units. Every window is assigned to one position inside it,
the place of its least-valued seed, a stretch of a few units. Equal windows choose the same place,
so a window can occur again only if its seed does. Consecutive windows with one seed form a run.

1. Ranks of seeds. Runs are dealt by their seed. A seed that occurs once is unique: all its windows are,
   and it drops out. For every distinct run of a seed that recurs, the first place is its rank.
2. Runs that are equal as a whole are settled at once: they hold the same windows. What is left open is
   the first run of each content where a seed has several.
3. Ranks of whole windows, for open runs only: names of windows are dealt, unique ones drop out,
   and the first place of each name is its rank.

Documents are ordered by id, null first; two texts under one id by a hash of the text. Rows that repeat both id and
text are equal in this order, so neither is earlier than the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm import names
from tickloom.llm.common import as_bytes, released, written
from tickloom.llm.names import TILE, Named, Powers, mix

RUN = [("h", "u4"), ("g", "u8"), ("id", "i8"), ("tag", "u4"), ("at", "u4"), ("n", "u4")]
RANK = [("g", "u8"), ("id", "i8"), ("tag", "u4"), ("at", "u4"), ("flag", "u1")]
PLACE = [("g", "u8"), ("id", "i8"), ("tag", "u4"), ("at", "u4"), ("span", "u2")]
WINDOW = [("name", "u8"), ("id", "i8"), ("tag", "u4"), ("at", "u4"), ("n", "u4")]
WINDOW_RANK = [("name", "u8"), ("id", "i8"), ("tag", "u4"), ("at", "u4")]
AGAIN, OPEN = 1, 2  # flags of a rank: the run recurs; its seed has other runs
TOGETHER = 1 << 18  # bytes of short texts whose runs are found in one pass


class Sequence:
    """How texts become sequences, and what is looked for in them."""

    window: int
    seed: int
    keep_first: bool  # only later occurrences count, else all

    def values(self, text: bytes) -> np.ndarray:
        """A random-looking value for each unit."""
        raise NotImplementedError

    def values_of_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all texts one after the other, and where each text begins; the end comes last."""
        parts = [self.values(t) for t in texts]
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def size(self, text: bytes) -> int:
        raise NotImplementedError

    def kept(self, text: bytes, keep: np.ndarray) -> bytes:
        raise NotImplementedError

    def seed_names(self, named: Named) -> np.ndarray:
        return mix(named.every(self.seed))

    def window_names(self, named: Named) -> np.ndarray:
        return mix(named.every(self.window))


def runs_of(values: np.ndarray, rule: Sequence, powers: Powers) -> Iterator[dict[str, np.ndarray]]:
    """Runs of a document: seed name ``full``, content ``g``, first window ``at``, windows after it ``span``, seed's place."""
    at = 0
    while at + rule.window <= len(values):
        named = Named(values[at : at + TILE], powers)
        seeds, place = _places(named, rule)
        cuts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(place)]])
        run = _described(named, rule, seeds, cuts[:-1], cuts[1:] - 1, place[cuts[:-1]])
        yield run | {"at": run["at"] + at, "spot": run["spot"] + at}
        at += len(place)


def _places(named: Named, rule: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Names of all seeds, and the place of the seed of every window."""
    seeds = rule.seed_names(named)
    low = np.uint64(20)
    marked = (seeds >> low << low) | np.arange(len(seeds), dtype=np.uint64)
    return seeds, (names.least_of(marked, rule.window - rule.seed + 1) & np.uint64(TILE - 1)).astype(np.int64)


def _described(named: Named, rule: Sequence, seeds: np.ndarray, first: np.ndarray, last: np.ndarray, spot: np.ndarray) -> dict[str, np.ndarray]:
    """Runs from their first and last windows and the places of their seeds."""
    full = seeds[spot]
    shape = ((spot - first) * 2048 + (last - first)).astype(np.uint64)
    content = mix(named.at(first, last + rule.window) + mix(shape, 1), 2) + mix(full, 3)
    return {"full": full, "g": mix(content, 4), "at": first, "span": last - first, "spot": spot}


def runs_of_all(texts: list[bytes], rule: Sequence, powers: Powers) -> Iterator[dict[str, np.ndarray]]:
    """``runs_of`` of all texts in their order, with ``doc``, the text's place in the list; short texts share a pass."""
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= min(TOGETHER, TILE):
            size += len(texts[hi])
            hi += 1
        if hi - lo == 1:
            for run in runs_of(rule.values(texts[lo]), rule, powers):
                yield run | {"doc": np.full(len(run["at"]), lo)}
        else:
            values, bounds = rule.values_of_all(texts[lo:hi])
            if len(values) >= rule.window:
                named = Named(values, powers)
                seeds, place = _places(named, rule)
                # Windows of one text only. Their seeds are inside it, so no run goes from one text to the next.
                inside = np.arange(len(place)) + rule.window <= np.repeat(bounds[1:], np.diff(bounds))[: len(place)]
                window = np.flatnonzero(inside)
                place = place[window]
                cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]])) if len(window) else np.zeros(1, np.int64)
                run = _described(named, rule, seeds, window[cuts[:-1]], window[cuts[1:] - 1], place[cuts[:-1]])
                doc = np.searchsorted(bounds, run["at"], side="right") - 1
                yield run | {"at": run["at"] - bounds[doc], "spot": run["spot"] - bounds[doc], "doc": doc + lo}
        lo = hi


def with_identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__rest`` (all columns but the text, and ``void``: it was null), ``__text`` bytes, and the order of documents, ``__id`` and ``__tag``."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    rest.append(F.col(f"`{text_col}`").isNull().alias("void"))
    held = docs.select(F.struct(*rest).alias("__rest"), as_bytes(text_col).alias("__text"), F.col(f"`{id_col}`").cast("long").alias("__own"))
    text = F.coalesce("__text", F.lit(b""))
    return held.select(
        "__rest",
        "__text",
        F.coalesce("__own", F.lit(-(1 << 63)).cast("long")).alias("__id"),
        F.shiftrightunsigned(F.xxhash64(text), 32).alias("__tag"),
    )


def column_places(docs: DataFrame) -> list[tuple[str, str]]:
    """Field of ``__rest`` and name of every column of ``docs``; the text has no field."""
    return [(f"c{i}", c) for i, c in enumerate(docs.columns)]


def _run_entries(rule: Sequence, columns: list[str]) -> Callable[[pa.RecordBatch], Iterator[dict[str, np.ndarray]]]:
    powers: list[Powers] = []

    def entries(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        if not powers:
            powers.append(Powers())
        texts = batch.column("__text").to_pylist()
        spots = batch.column("__spots").to_pylist() if "__spots" in batch.schema.names else None
        rows = [i for i, text in enumerate(texts) if text and (spots is None or spots[i])]
        doc, tag = (np.asarray(batch.column(n))[rows] for n in ("__id", "__tag"))
        if spots is not None:
            held = [np.frombuffer(spots[i], np.uint32).astype(np.int64) + (at << 32) for at, i in enumerate(rows)]  # sorted
            known = np.concatenate(held) if held else np.zeros(0, np.int64)
        for run in runs_of_all([texts[i] for i in rows], rule, powers[0]):
            if spots is not None:
                wanted = (run["doc"] << 32) + run["spot"]
                near = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                run = names.taken(run, np.flatnonzero(known[near] == wanted))
            run |= {"h": run["full"] & np.uint64(0xFFFFFFFF), "id": doc[run["doc"]], "tag": tag[run["doc"]]}
            run |= {"n": np.ones(len(run["at"]), np.int64), "deal_by": run["full"]}
            yield {c: run[c] for c in [*columns, "deal_by"]}

    return entries


def _rank_runs(parts: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], int]:
    held = names.merged(names.joined(parts, RUN), "g")
    order = np.argsort(held["h"], kind="stable")
    held = names.taken(held, order)
    first = np.ones(len(order), bool)
    first[1:] = held["h"][1:] != held["h"][:-1]
    group = np.cumsum(first) - 1
    again = held["n"] > 1
    several = np.bincount(group)[group] > 1
    held["flag"] = again * AGAIN + several * OPEN
    held = names.taken(held, np.flatnonzero(again | several))
    return names.taken(held, np.argsort(held["g"], kind="stable")), int(held["n"].sum())


def _hits(entries: dict[str, np.ndarray], known: dict[str, np.ndarray], column: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Which entries have a rank, and the rank of each of them."""
    spot = np.minimum(np.searchsorted(known[column], entries[column]), max(len(known[column]) - 1, 0))
    rows = np.flatnonzero(known[column][spot] == entries[column]) if len(known[column]) else np.zeros(0, np.int64)
    return rows, names.taken(known, spot[rows])


def _by_document(held: dict[str, np.ndarray], values: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch | None:
    """A row for each document with the packed values (u4) of its rows, for each (name, which rows, values)."""
    any_of = np.zeros(len(held["id"]), bool)
    for _, which, _ in values:
        any_of |= which
    rows = np.flatnonzero(any_of)
    if not len(rows):
        return None
    rows = rows[np.lexsort((held["tag"][rows], held["id"][rows]))]
    doc, tag = held["id"][rows], held["tag"][rows].astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]), [True]]))
    arrays = [pa.array(doc[cuts[:-1]]), pa.array(tag[cuts[:-1]])]
    for _, which, packed in values:
        chosen, data = which[rows], packed[rows].astype(np.uint32)
        arrays.append(pa.array([data[lo:hi][chosen[lo:hi]].tobytes() or None for lo, hi in zip(cuts[:-1], cuts[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["__id", "__tag", *(n for n, _, _ in values)])


def _settled_runs(rule: Sequence) -> Callable[[dict, dict], pa.RecordBatch | None]:
    def found(entries: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        rows, rank = _hits(entries, known, "g")
        held = names.taken(entries, rows)
        own = names.same_place(held, rank)
        gone = ~own if rule.keep_first else (rank["flag"] & AGAIN) > 0
        still = own & ((rank["flag"] & OPEN) > 0)
        first = held["at"].astype(np.int64)
        last = first + held["span"]
        return _by_document(
            held,
            [("gone", gone, np.stack([first, last + rule.window], axis=1)), ("still", still, np.stack([first, last], axis=1))],
        )

    return found


def _marked(n: int, pairs: np.ndarray) -> np.ndarray:
    """Units covered by any of the (start, end) pairs."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, pairs[:, 0], 1)
    np.add.at(edges, np.minimum(pairs[:, 1], n), -1)
    return np.cumsum(edges[:-1]) > 0


def _pairs(parts: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(p for p in parts or [] if p), np.uint32).reshape(-1, 2).astype(np.int64)


RESULT = [
    T.StructField("n_units", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()),
    T.StructField("kept_sha256", T.StringType()),
    T.StructField("kept", T.BinaryType()),
]


def _finished(rule: Sequence, text: bytes | None, pairs: np.ndarray, with_text: bool) -> tuple:
    n = rule.size(text or b"")
    gone = _marked(n, pairs) if len(pairs) else np.zeros(n, bool)
    kept = rule.kept(text or b"", ~gone)
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None


def _first_results(rule: Sequence, joined: DataFrame, with_text: bool) -> DataFrame:
    """Results of documents without open runs; the others keep their text, settled pairs and open runs."""
    more = [T.StructField(n, T.BinaryType()) for n in ("text", "gone", "still")]
    schema = T.StructType([joined.schema["__rest"], joined.schema["__id"], joined.schema["__tag"], *RESULT, *more])

    def step(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for text, gone, still in zip(*(batch.column(n).to_pylist() for n in ("__text", "gone", "still"))):
                still = b"".join(p for p in still or [] if p)
                if still:
                    rows.append((None, None, None, None, None, text, b"".join(p for p in gone or [] if p), still))
                else:
                    rows.append((*_finished(rule, text, _pairs(gone), with_text), None, None, None))
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * 4
            made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("__rest", "__id", "__tag")] + made, names=schema.names)

    return joined.select("__rest", "__id", "__tag", "__text", "gone", "still").mapInArrow(step, schema)


def _window_entries(rule: Sequence) -> Callable[[pa.RecordBatch], Iterator[dict[str, np.ndarray]]]:
    powers: list[Powers] = []

    def entries(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
        if not powers:
            powers.append(Powers())
        for doc, tag, text, still in zip(*(batch.column(n).to_pylist() for n in ("__id", "__tag", "text", "still"))):
            values, at = rule.values(text), 0
            ranges = _pairs([still])
            live = np.flatnonzero(_marked(len(values), ranges + np.array([0, 1])))
            while at + rule.window <= len(values):
                named = Named(values[at : at + TILE], powers[0])
                made = rule.window_names(named)
                lo, hi = np.searchsorted(live, [at, at + len(made)])
                here = live[lo:hi] - at
                n = len(here)
                if n:
                    yield {
                        "name": made[here],
                        "id": np.full(n, doc, np.int64),
                        "tag": np.full(n, tag, np.int64),
                        "at": here + at,
                        "n": np.ones(n, np.int64),
                        # Another function of the same window, so that the bucket adds to its name.
                        "deal_by": mix(named.every(rule.window)[here] + np.uint64(1), 5) ^ mix(named.at(here, here + rule.seed), 6),
                    }
                at += len(made)

    return entries


def _rank_windows(parts: list[dict[str, np.ndarray]]) -> tuple[dict[str, np.ndarray], int]:
    held = names.merged(names.joined(parts, WINDOW), "name")
    held = names.taken(held, np.flatnonzero(held["n"] > 1))
    return names.taken(held, np.argsort(held["name"], kind="stable")), int(held["n"].sum())


def _found_windows(rule: Sequence) -> Callable[[dict, dict], pa.RecordBatch | None]:
    def found(entries: dict[str, np.ndarray], known: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        rows, rank = _hits(entries, known, "name")
        held = names.taken(entries, rows)
        gone = ~names.same_place(held, rank) if rule.keep_first else np.ones(len(rows), bool)
        return _by_document(held, [("starts", gone, held["at"])])

    return found


def remove_repeats(docs: DataFrame, rule: Sequence, with_text: bool = False) -> DataFrame:
    """``__rest, n_units, n_removed, n_spans, kept_sha256, kept`` for every row of ``docs(__rest, __text, __id, __tag)``.

    Units under a window that occurs again are removed; all windows are judged on the input. A null text has no
    units. ``kept`` is null unless ``with_text``. ``docs`` may have ``__spots``: places (u4) of the seeds to heed.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.length("__text").cast("double"))).first()[0] or 0.0
    # About two runs for each seed-free width; texts of words have fewer, which only makes buckets smaller.
    buckets = names.bucket_count(2 * size / (rule.window - rule.seed + 2))
    dealt = names.deal(docs, _run_entries(rule, [n for n, _ in RUN]), RUN, buckets, merge_by="g")
    ranks = written(names.by_bucket(dealt, _rank_runs, RUN, RANK), "run-ranks")
    released(spark)
    salts = names.salts_of(ranks)
    places = names.deal(docs, _run_entries(rule, [n for n, _ in PLACE]), PLACE, buckets, salts=salts)
    settled = names.looked_up(
        places, ranks, salts, PLACE, RANK, _settled_runs(rule), "__id long, __tag long, gone binary, still binary"
    )
    settled = written(settled, "settled-runs")
    released(spark)
    lists = settled.groupBy("__id", "__tag").agg(F.collect_list("gone").alias("gone"), F.collect_list("still").alias("still"))
    joined = docs.select("__rest", "__text", "__id", "__tag").join(lists, ["__id", "__tag"], "left")
    first = written(_first_results(rule, joined, with_text), "first-results")
    released(spark)

    opened = first.where(F.col("still").isNotNull())
    work = opened.select("__id", "__tag", "text", "still")
    amount = opened.agg(F.sum(F.length("still") / 8.0)).first()[0] or 0.0
    count = names.bucket_count(amount * (rule.window - rule.seed + 2) / 2)
    dealt = names.deal(work, _window_entries(rule), WINDOW, count, merge_by="name")
    ranks = written(names.by_bucket(dealt, _rank_windows, WINDOW, WINDOW_RANK), "window-ranks")
    released(spark)
    salts = names.salts_of(ranks)
    windows = names.deal(work, _window_entries(rule), WINDOW_RANK, count, salts=salts)
    found = names.looked_up(windows, ranks, salts, WINDOW_RANK, WINDOW_RANK, _found_windows(rule), "__id long, __tag long, starts binary")
    found = written(found, "found-windows")
    released(spark)
    lists = found.groupBy("__id", "__tag").agg(F.collect_list("starts").alias("starts"))
    last = opened.select("__rest", "__id", "__tag", "text", "gone").join(lists, ["__id", "__tag"], "left")

    def finish(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = []
            for text, gone, starts in zip(*(batch.column(n).to_pylist() for n in ("text", "gone", "starts"))):
                at = np.frombuffer(b"".join(p for p in starts or [] if p), np.uint32).astype(np.int64)
                pairs = np.concatenate([_pairs([gone or b""]), np.stack([at, at + rule.window], axis=1)])
                rows.append(_finished(rule, text, pairs, with_text))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("__rest"), *made], names=["__rest", *(f.name for f in RESULT)])

    schema = T.StructType([docs.schema["__rest"], *RESULT])
    done = last.select("__rest", "text", "gone", "starts").mapInArrow(finish, schema)
    return first.where(F.col("still").isNull()).select("__rest", *(f.name for f in RESULT)).union(done)
