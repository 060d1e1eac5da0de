"""Lines that several documents hold, kept in the first of them only.

Every text is exploded into lines; a line's key is the line without white space at its ends and with A-Z in small letters.
Keys travel as 128-bit hashes, one row for each key of a document with the positions of its lines. Documents are
counted for each hash in two steps (hash and document, then hash), so a line that a third of all rows hold is
combined before it meets in one task. Hashes of more than a ``SHARE`` of all rows are at most ``1 / SHARE`` and are joined by
broadcast; of the others none is large. The positions to drop are joined back to their document, which
is put together again in their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import as_bytes, batches, written

LEAST_DOCS = 2
LEAST_CHARS = 10
SHARE = 1e-4
_SPACE = b" \t\n\x0b\x0c\r"
_INNER = bytes(range(0x80, 0xC0))  # bytes inside a code point


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def is_long(key: bytes, least: int) -> bool:
    """Whether the key has at least ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.translate(None, _INNER)) >= least)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``__c0...`` of ``docs``, and ``__id, __tag, __text``: rows of one id and one text share their decisions."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    held = docs.toDF(*names)
    own = {c: held[n] for c, n in zip(docs.columns, names)}
    text = F.coalesce(own[text_col].cast("string"), F.lit("")).cast("binary")
    return held.select("*", own[id_col].cast("long").alias("__id"), F.xxhash64(text).alias("__tag"), text.alias("__text"))


def keyed_lines(identified: DataFrame, least_chars: int) -> DataFrame:
    """``h1, h2, id, tag, places``: one row for each key of a document, with the positions of its lines."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, rows, places = [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            held: dict[bytes, list[int]] = {}
            for at, line in enumerate(text.split(b"\n")):
                key = line_key(line)
                if is_long(key, least_chars):
                    held.setdefault(key, []).append(at)
            hashes += map(xxhash.xxh3_128_digest, held)
            rows += [row] * len(held)
            places += held.values()
        halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        chosen = pa.array(rows, pa.int64())
        columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(chosen), batch.column(1).take(chosen)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(places, pa.list_(pa.int32()))], names=["h1", "h2", "id", "tag", "places"])

    return batches(identified.select("__id", "__tag", "__text"), step, "h1 long, h2 long, id long, tag long, places array<int>")


def shared_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """``h1, h2, first, n``: keys that at least ``least_docs`` documents hold, the least id of these, the rows."""
    held = lines.groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
    counted = held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.sum("n").alias("n"))
    return counted.where(F.col("docs") >= least_docs).select("h1", "h2", "first", "n")


def dropped_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """``id, tag, gone``: the positions of all lines to drop in every document that loses some."""
    key = ["h1", "h2"]
    shared = written(shared_keys(lines, least_docs), "shared-lines")
    most = lines.count() * SHARE
    hot = F.broadcast(shared.where(F.col("n") > most))
    cold = shared.where(F.col("n") <= most)
    met = lines.join(hot, key).unionByName(lines.join(hot, key, "left_anti").join(cold, key))
    lost = met.where(~F.col("id").eqNullSafe(F.col("first")))
    return lost.groupBy("id", "tag").agg(F.flatten(F.collect_set("places")).alias("gone"))


def _rebuilt(text: bytes, gone: list[int] | None) -> tuple[bytes, int]:
    split = text.split(b"\n")
    if not gone:
        return text, len(split)
    keep = np.ones(len(split), bool)
    keep[gone] = False
    return b"\n".join([split[i] for i in np.flatnonzero(keep).tolist()]), len(split)


def _cut(docs: DataFrame, id_col: str, text_col: str, least_docs: int, least_chars: int) -> DataFrame:
    """``docs`` as ``__c0...``, and ``__kept`` (bytes), ``__lines``, ``__dropped``."""
    held = _identified(docs, id_col, text_col)
    lines = written(keyed_lines(held, least_chars), "lines")
    gone = dropped_lines(lines, least_docs)
    same = held["__id"].eqNullSafe(gone["id"]) & (held["__tag"] == gone["tag"])
    joined = held.join(gone, same, "left").drop("__id", "__tag", "id", "tag")
    fields = [f for f in joined.schema.fields if f.name not in ("__text", "gone")]
    more = [T.StructField("__kept", T.BinaryType()), T.StructField("__lines", T.LongType()), T.StructField("__dropped", T.LongType())]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, sizes, lost = [], [], []
        for text, places in zip(batch.column("__text").to_pylist(), batch.column("gone").to_pylist()):
            left, n = _rebuilt(text, places)
            kept.append(left)
            sizes.append(n)
            lost.append(len(places or ()))
        columns = [batch.column(f.name) for f in fields]
        made = [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *made], names=[f.name for f in [*fields, *more]])

    return batches(joined, step, T.StructType([*fields, *more]))


def without_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS
) -> DataFrame:
    """``docs``, its texts without the lines that a document of a smaller id holds too.

    Lines end at ``\\n``. Keys of at least ``least_chars`` code points that ``least_docs`` documents hold stay in the
    document of the smallest id only, there with all their lines. Rows of one id are one document; all null ids are one
    document too, which comes after all others. A null text stays null, a text that loses all its lines becomes
    empty. Repeated rows all stay, each cut alike; an empty table gives none.
    """
    cut = _cut(docs, id_col, text_col, least_docs, least_chars)
    at = docs.columns.index(text_col)
    text = F.when(F.col(f"__c{at}").isNotNull(), F.col("__kept").cast("string"))
    return cut.select(*(text.alias(c) if i == at else F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))


def line_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` for every row; cases as in ``without_shared_lines``, a null text is one empty line."""
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    cut = _cut(slim, "doc_id", "text", LEAST_DOCS, LEAST_CHARS)
    return cut.select(F.col("__c0").alias("doc_id"), F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))
