"""Benchmark items in documents, up to a number of edits.

Text is compared in small letters with words joined by single spaces. An item of ``m`` characters may
be off by ``e = m * rate`` edits. Cut into ``e + 1`` pieces, at least one piece of every occurrence
is unharmed (pigeonhole), so exact hits of pieces, found by one automaton over all items of a
block, are the only places to look at. There Myers' bit-parallel distance, whose columns are the
bits of one whole number, gives the least distance of the item to any stretch of the document.

Items pass in blocks of bounded size, so a longer benchmark means more passes and not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches, id_and_text

ERROR_RATE = 0.06
BLOCK_CHARS = 4_000_000  # characters of items in one pass
LEAST_CHARS = 20  # a shorter item says too little to be searched with edits


def plain(text: bytes | str | None) -> str:
    text = text.decode("utf-8", "replace") if isinstance(text, bytes) else text or ""
    return " ".join(text.lower().split())


def budget(item: str, rate: float) -> int:
    return int(len(item) * rate) if len(item) >= LEAST_CHARS else 0


def pieces(item: str, edits: int) -> Iterator[tuple[int, str]]:
    """Offset and text of ``edits + 1`` pieces of nearly equal length."""
    n = edits + 1
    for i in range(n):
        lo, hi = len(item) * i // n, len(item) * (i + 1) // n
        yield lo, item[lo:hi]


def letters(item: str) -> dict[str, int]:
    """For every character the positions in the item where it stands, as bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def nearest(masks: dict[str, int], size: int, text: str, most: int) -> tuple[int, int] | None:
    """Least distance of the item to a stretch of ``text`` and the first end of one, if at most ``most``."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, distance = full, 0, size
    best, end = most + 1, -1
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | (~(xh | up) & full)
        minus = up & xh
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up = minus | (~(xv | plus) & full)
        down = plus & xv
        if distance < best:
            best, end = distance, i + 1
    return (best, end) if end >= 0 else None


class ItemSearch:
    """Pieces of a block of items in one automaton, and the search of one document."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        self.items = [(i, text, budget(text, rate), letters(text)) for i, text in items if text]
        spots: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, edits, _) in enumerate(self.items):
            for offset, piece in pieces(text, edits):
                spots.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in spots.items():
            self.automaton.add_word(piece, (len(piece), where))
        if spots:
            self.automaton.make_automaton()

    def found(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item to (distance, end, occurrences) of its nearest stretches; the first of the least wins."""
        places: dict[int, list[int]] = {}
        if self.items:
            for end, (size, where) in self.automaton.iter(text):
                for n, offset in where:
                    places.setdefault(n, []).append(end + 1 - size - offset)
        out = {}
        for n, starts in places.items():
            _, item, edits, masks = self.items[n]
            best, count, reach = None, 0, -1
            # Starts that lie closer than the budget share a stretch: it is searched once.
            for lo, hi in self._stretches(sorted(starts), len(item), edits, len(text)):
                hit = nearest(masks, len(item), text[lo:hi], edits)
                if hit and lo + hit[1] > reach:
                    count, reach = count + 1, lo + hit[1]
                    if best is None or hit[0] < best[0]:
                        best = (hit[0], lo + hit[1])
            if best:
                out[n] = (*best, count)
        return out

    @staticmethod
    def _stretches(starts: list[int], size: int, edits: int, length: int) -> Iterator[tuple[int, int]]:
        """Stretches around the starts; joined only where one start is within the budget of the last."""
        first = last = starts[0]
        for start in starts[1:]:
            if start - last > 2 * edits:
                yield max(0, first - edits), min(length, last + size + edits)
                first = start
            last = start
        yield max(0, first - edits), min(length, last + size + edits)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, read one by one; null ids and empty texts are no items."""
    held, weight = [], 0
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    for row in rows.where("i is not null").distinct().orderBy("i", "t").toLocalIterator():
        text = plain(row["t"])
        if text:
            held.append((row["i"], text))
            weight += len(text)
        if weight >= BLOCK_CHARS:
            yield held
            held, weight = [], 0
    yield held


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
) -> DataFrame:
    """``doc_id, item_id, distance, span_end, n_found``: documents that hold an item within its budget.

    ``span_end`` counts characters of the plain text up to the end of the nearest stretch. Null and empty
    texts hold nothing. Repeated documents give repeated rows; of items that share an id the nearest counts.
    Items shorter than ``LEAST_CHARS`` are searched without edits.
    """
    schema = "doc_id long, item_id long, distance int, span_end int, n_found int"
    sc, slim = docs.sparkSession.sparkContext, id_and_text(docs, id_col, text_col)

    def over(block: list[tuple[int, str]]) -> DataFrame:
        shared = sc.broadcast(block)  # at most BLOCK_CHARS and one item
        search: list[ItemSearch] = []

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if not search:
                search.append(ItemSearch(shared.value, rate))
            rows = []
            for doc, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist()):
                nearest_of: dict[int, tuple[int, int, int]] = {}
                for n, hit in search[0].found(plain(text)).items():
                    item = search[0].items[n][0]
                    nearest_of[item] = min(hit, nearest_of.get(item, hit))
                rows += [(doc, item, *hit) for item, hit in sorted(nearest_of.items())]
            if not rows:
                return None
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            names = ["doc_id", "item_id", "distance", "span_end", "n_found"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        return batches(slim, step, schema)

    made = None
    for block in _blocks(items, item_id_col, item_text_col):
        made = over(block) if made is None else made.union(over(block))
    return made


def without_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text_col: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """``docs`` without the rows whose text holds any item, in as many passes as there are blocks of items."""
    sc, kept = docs.sparkSession.sparkContext, docs
    for block in _blocks(items, "item_id", item_text_col):
        shared = sc.broadcast(block)
        kept = _clean_rows(kept, text_col, shared, rate)
    return kept


def _clean_rows(docs: DataFrame, text_col: str, shared, rate: float) -> DataFrame:
    names, place = [f"__c{i}" for i in range(len(docs.columns))], docs.columns.index(text_col)
    search: list[ItemSearch] = []
    held = docs.toDF(*names)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not search:
            search.append(ItemSearch(shared.value, rate))
        clean = [not search[0].found(plain(t)) for t in batch.column(place).to_pylist()]
        return batch.filter(pa.array(clean, pa.bool_()))

    return batches(held, step, held.schema).toDF(*docs.columns)
