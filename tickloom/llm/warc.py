"""WARC archives as a chunked record table.

A payload never stands in memory whole once it is in the table: it is a run of rows
``(record, chunk)``, each with a piece of at most ``CHUNK`` bytes and the SHA-1 of all bytes up to
its end. In the archive the first piece is a ``response`` record and the others are
``continuation`` records with their segment number (WARC 1.1 segmentation), so writer and
reader handle one piece at a time. A cut is also made inside every "WARC/1.1" in a payload;
the version line then opens records and nothing else, and Spark's text reader cuts archives at it.

Archives are written and read by Spark alone, so they can lie in any store that it knows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes
from tickloom.session import fresh_path

CHUNK = 1 << 16
LEAST_REVISIT = 1000  # bytes below which equal payloads are stored again
VERSION = b"WARC/1.1"
MARK = VERSION + b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def pieces(payload: bytes, size: int = CHUNK) -> Iterator[memoryview]:
    """The payload in pieces of at most ``size`` bytes, none of which holds the version; one empty piece for none."""
    view, at, found = memoryview(payload), 0, payload.find(VERSION)
    while True:
        while found >= 0 and found + len(VERSION) // 2 <= at:
            found = payload.find(VERSION, found + 1)
        cut = len(payload) if found < 0 else found + len(VERSION) // 2
        end = min(at + size, cut)
        yield view[at:end]
        at = end
        if at >= len(payload):
            return


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, payload_digest, payload_bytes, record_type, refers_to``.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the largest page id is stored, the others
    revisit it. A null id is the least of all. Rows that repeat the largest id are stored each. A null
    payload is empty.
    """
    html = F.coalesce(as_bytes(html_col), F.lit(b""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        html.alias("html"),
        F.sha1(html).alias("payload_digest"),
        F.length(html).cast("long").alias("payload_bytes"),
    )
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).select("payload_digest", "payload_bytes", "page_id")
    stored = large.groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    placed = rows.join(stored.where("n > 1"), ["payload_digest", "payload_bytes"], "left")
    again = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return placed.select(
        "page_id", "url", "html", "payload_digest", "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("top")).alias("refers_to"),
    )


def _records(row: dict, size: int) -> Iterator[list[bytes]]:
    """The record of a page: every segment as the lines that, each closed by CR LF, make it up."""
    record, revisit = f"urn:uuid:{uuid.uuid4()}", row["record_type"] == "revisit"
    digest, seen = hashlib.sha1(), 0
    url = "".join((row["url"] or "urn:none").split()).replace("WARC/", "WARC%2F")
    parts = [memoryview(b"")] if revisit else pieces(row["html"], size)
    total = row["payload_bytes"]
    for n, piece in enumerate(parts, 1):
        digest.update(piece)
        seen += len(piece)
        last = revisit or seen == total
        head = HTTP if n == 1 else b""
        fields: dict[str, object] = {
            "WARC-Record-ID": f"<{record}>" if n == 1 else f"<urn:uuid:{uuid.uuid4()}>",
            "WARC-Date": "2024-01-01T00:00:00Z",
            "WARC-Target-URI": url,
            "Tickloom-Page-Id": row["page_id"],
            "WARC-Segment-Number": None if n == 1 and last else n,
            "Tickloom-Digest-So-Far": digest.hexdigest(),
            "Content-Length": len(head) + len(piece),
        }
        if n == 1:
            fields |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{row['payload_digest']}"}
        else:
            fields["WARC-Segment-Origin-ID"] = f"<{record}>"
        if last:
            fields["WARC-Segment-Total-Length"] = total
        if revisit:
            fields |= {
                "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                "Tickloom-Refers-To-Page-Id": row["refers_to"],
            }
        kind = "revisit" if revisit else "response" if n == 1 else "continuation"
        # The text writer ends each line with CR LF: after the head that makes the empty line, after the block
        # the first of the two that end a record, and an empty line the second.
        yield [_head(kind, fields), head + bytes(piece), b""]


def _head(kind: str, fields: dict[str, object]) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return MARK + "\r\n".join(lines).encode() + b"\r\n"


def write_archives(plan: DataFrame, path: str, size: int = CHUNK) -> None:
    """The rows of ``planned`` as gzipped WARC files under ``path``, through Spark's text writer."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in stream:
            for row in batch.to_pylist():
                for lines in _records(row, size):
                    held += lines
                    weight += len(lines[1])
                    if weight >= 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    lines = plan.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _field(name: str) -> F.Column:
    return F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of the archives under ``path``: a row for each stored piece."""
    archives = spark.read.option("lineSep", MARK.decode()).text(path)
    # A record is: head, empty line, block, empty line; the block is cut out by its length.
    split = archives.where(F.length("value") > 0).withColumn("head", F.substring_index("value", "\r\n\r\n", 1))
    start = F.octet_length("head") + 4
    block = F.expr("substring(raw, start + 1, size)")
    parsed = split.select(
        F.col("value").cast("binary").alias("raw"), "head", start.cast("int").alias("start"), _field("Content-Length").cast("int").alias("size")
    )
    kind = _field("WARC-Type")
    http = F.when(kind == "continuation", 0).otherwise(F.lit(len(HTTP)))
    return parsed.select(
        F.regexp_extract(F.coalesce(_field("WARC-Segment-Origin-ID"), _field("WARC-Record-ID")), "<(.*)>", 1).alias("record"),
        _field("Tickloom-Page-Id").cast("long").alias("page_id"),
        kind.alias("record_type"),
        _field("Tickloom-Refers-To-Page-Id").cast("long").alias("refers_to"),
        (F.coalesce(_field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk"),
        _field("WARC-Segment-Total-Length").isNotNull().alias("last"),
        block.alias("block"),
        http.alias("http"),
        _field("Tickloom-Digest-So-Far").alias("digest"),
        F.coalesce(_field("WARC-Segment-Total-Length").cast("long"), F.lit(-1).cast("long")).alias("total"),
        F.regexp_extract(F.coalesce(_field("WARC-Payload-Digest"), F.lit("")), "sha1:(.*)", 1).alias("payload_digest"),
    ).withColumn("piece", F.expr("substring(block, http + 1, length(block))")).drop("block", "http")


def records(chunks: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, sound`` from a chunk table.

    A record of one piece is checked where it is read. The pieces of the others pass in order, one at a
    time, with the state of their digest. ``sound`` says that all pieces were there and that each
    digest so far and the whole one agree. A revisit has no payload: length and digest are its header's.
    """
    one = (F.col("chunk") == 0) & F.col("last")
    revisit = F.col("record_type") == "revisit"
    own = F.sha1("piece")
    single = chunks.where(one).select(
        "page_id",
        F.when(revisit, F.col("total")).otherwise(F.length("piece").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("payload_digest")).otherwise(own).alias("payload_digest"),
        "record_type",
        "refers_to",
        (revisit | ((own == F.col("payload_digest")) & (F.length("piece") == F.col("total")))).alias("sound"),
    )
    return single.union(_streamed(chunks.where(~one)))


def _streamed(chunks: DataFrame) -> DataFrame:
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, sound boolean"

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in stream:
            done = []
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    state = {"record": row["record"], "sha": hashlib.sha1(), "n": 0, "next": 0, "sound": True, "first": row}
                if state is None or state["record"] != row["record"]:
                    continue  # a piece whose first part is missing belongs to no record
                state["sha"].update(row["piece"])
                state["n"] += len(row["piece"])
                state["sound"] &= row["chunk"] == state["next"] and row["digest"] == state["sha"].hexdigest()
                state["next"] += 1
                if row["last"]:
                    first, size, sha = state["first"], state["n"], state["sha"].hexdigest()
                    state["sound"] &= size == row["total"] and sha == first["payload_digest"]
                    done.append((first["page_id"], size, sha, first["record_type"], first["refers_to"], state["sound"]))
                    state = None
            if done:
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_())
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

    ordered = chunks.repartition("record").sortWithinPartitions("record", "chunk")
    return ordered.mapInArrow(run, schema)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages to archives in the shared folder, read these back and check every digest."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(planned(pages, id_col, url_col, html_col), path)
    return records(read_chunks(pages.sparkSession, path))
