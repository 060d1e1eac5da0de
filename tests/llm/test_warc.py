"""Archives: exact round trip of payloads, cuts, and odd pages."""

import gzip
import hashlib
from pathlib import Path

from tickloom.llm import warc


def test_pieces_join_and_never_hold_the_version():
    for payload in (b"", b"abc", b"x" * 100, b"WARC/1.1", b"aWARC/1.1\r\nbWARC/1.1WARC/1.1", b"WARC/1.1\r\n" * 9):
        for size in (1, 3, 8, 50):
            made = [bytes(p) for p in warc.pieces(payload, size)]
            assert b"".join(made) == payload and made
            assert all(len(p) <= size and b"WARC/1.1" not in p for p in made)


def test_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 60
    rows = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y WARC/1.1", big),
            (6, "u", big), (7, "u", big + "x"), (7, "u", big + "x"), (None, "u", big), (8, "u", "WARC/1.1"), (9, "u", "a\r\n"),
            (10, "u", big + "tail")]
    pages = spark.createDataFrame([(*r, "x", 9) for r in rows], "page_id long, url string, html string, record_type string, n int")
    warc.write_archives(warc.planned(pages), str(tmp_path / "a"), 500)
    chunks = warc.read_chunks(spark, str(tmp_path / "a"))
    assert chunks.where("octet_length(piece) > 500").count() == 0
    got = sorted((tuple(r) for r in warc.records(chunks).collect()), key=repr)
    wanted = []
    for page, _, html in rows:
        data = (html or "").encode()
        again = html == big and page != 6
        wanted.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 6 if again else None, True))
    assert got == sorted(wanted, key=repr)
    # The files themselves are well-formed: every record is as long as it says.
    for part in Path(tmp_path / "a").glob("part-*"):
        data = gzip.decompress(part.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]


def test_damage_is_seen(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab" * 900)], "page_id long, url string, html string")
    warc.write_archives(warc.planned(pages), str(tmp_path / "a"), 500)
    chunks = warc.read_chunks(spark, str(tmp_path / "a"))
    assert [r.sound for r in warc.records(chunks.where("chunk != 1")).collect()] == [False]


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(pages).count() == 0
