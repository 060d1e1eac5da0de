"""Removal of repeated byte strings and word windows against plain dictionaries."""

import hashlib
import random

import numpy as np
import pytest

from tickloom.llm import names, phrases, repeats, substrings
from tickloom.llm.common import read_table


def order(row):
    return (row[0] is not None, row[0] if row[0] is not None else 0)


def plain_bytes(rows, size):
    """(id, text) to result; rows with one id and different texts are not used here."""
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=order):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - size + 1):
            s = data[p : p + size]
            if s in seen:
                gone[p : p + size] = True
            else:
                seen[s] = p
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int(sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)))
        out[doc] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def plain_words(rows, size):
    count = {}
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    for _, words in split:
        for p in range(len(words) - size + 1):
            key = tuple(words[p : p + size])
            count[key] = count.get(key, 0) + 1
    out = []
    for doc, words in split:
        gone = np.zeros(len(words), bool)
        for p in range(len(words) - size + 1):
            if count[tuple(words[p : p + size])] > 1:
                gone[p : p + size] = True
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def texts_of(seed, n=70):
    """Short texts over a small alphabet with shared, shifted and periodic stretches."""
    rng = random.Random(seed)
    words = ["ab", "ba", "é", "abc", "c", "bbb", "\U0001f600"]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(6)]
    rows = []
    for doc in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            if kind < 0.5:
                whole = rng.choice(shared)
                lo = rng.randint(0, len(whole) // 2)
                parts.append(whole[lo : lo + rng.randint(5, len(whole))])
            elif kind < 0.8:
                parts.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))))
            else:
                parts.append(rng.choice(["a ", "ab", "x"]) * rng.randint(1, 80))
        rows.append((doc, rng.choice(["", " "]).join(parts)))
    rows += [(n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 3, rows[3][1]), (None, rows[5][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,size", [(1, 20), (2, 8), (3, 13)])
def test_bytes_equal_plain(spark, seed, size):
    rows = texts_of(seed)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, n_bytes int")
    got = {r.doc_id: tuple(r)[1:] for r in substrings.cut_lengths(docs, window=size).collect()}
    assert got == plain_bytes(rows, size)


def test_bytes_across_tiles_and_salts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "TILE", 64)
    monkeypatch.setattr(names, "FLUSH", 50)
    monkeypatch.setattr(names, "BLOB", 4)
    monkeypatch.setattr(names, "salts_of", lambda settled: {b: 3 for b in range(0, 64, 2)})
    rows = texts_of(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in substrings.cut_lengths(docs, window=20).collect()}
    assert got == plain_bytes(rows, 20)


def test_documents_equal_plain(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: tuple(r)[1:] for r in substrings.cut_lengths(docs).collect()}
    assert got == plain_bytes(rows, 100)


def test_cut_texts_keep_columns_and_nulls(spark):
    text = "a passage that is long enough " * 5
    rows = [(2, text, "x"), (1, text, "y"), (3, None, "z"), (3, None, "z"), (4, "", None), (2, text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = sorted((tuple(r) for r in substrings.without_repeats(docs).collect()), key=repr)
    once = plain_bytes([(1, text)], 100)[1]
    kept = next(r for r in got if r[0] == 1)
    assert hashlib.sha256(kept[1].encode()).hexdigest() == once[3] and kept[2] == "y"
    rest = [(2, "", "x"), (2, "", "x"), (3, None, "z"), (3, None, "z"), (4, "", None)]
    assert [r for r in got if r[0] != 1] == sorted(rest, key=repr)
    assert substrings.without_repeats(docs.limit(0)).count() == 0
    assert substrings.cut_lengths(docs.limit(0)).count() == 0


def test_word_names_are_those_of_the_words(monkeypatch):
    rule = phrases.WordWindows()
    text = b"\x0b a bb\ta  a\r\n\xc3\xa9 bb " + b"z" * 50 + b" a" * 40
    words = text.split()
    for tile in (1 << 20, 16):
        monkeypatch.setattr(phrases, "TILE", tile)
        named = rule.values(text)
        assert len(named) == rule.size(text) == len(words)
        assert len(set(named.tolist())) == len(set(words)) == len(set(zip(words, named.tolist())))
    assert len(rule.values(b"")) == len(rule.values(b" \n ")) == 0


@pytest.mark.parametrize("seed,size", [(5, 9), (6, 5)])
def test_words_equal_plain(spark, seed, size):
    rows = texts_of(seed)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, __spots string")
    got = [tuple(r) for r in phrases.cut_counts(docs, window=size, seed=3).collect()]
    assert sorted(got, key=repr) == sorted(plain_words(rows, size), key=repr)


def test_word_documents_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 30_000)
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = [tuple(r) for r in phrases.cut_counts(docs).collect()]
    assert sorted(got) == sorted(plain_words(rows, 35))
    assert phrases.cut_counts(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", [phrases.WordWindows(12, 4), substrings.ByteStrings(20)])
def test_short_texts_share_a_pass(rule, monkeypatch):
    powers, made = names.Powers(), []
    texts = [(t or "").encode() for _, t in texts_of(5)] + [b"", b"a " * 400, b" \n "]
    alone = [
        (i, *(int(run[c][j]) for c in ("full", "g", "at", "span", "spot")))
        for i, t in enumerate(texts)
        for run in repeats.runs_of(rule.values(t), rule, powers)
        for j in range(len(run["at"]))
    ]
    plain = repeats.Named
    monkeypatch.setattr(repeats, "Named", lambda *x: made.append(1) or plain(*x))
    for together, passes in ((1 << 18, 1), (2000, len(texts)), (1, 2 * len(texts))):
        monkeypatch.setattr(repeats, "TOGETHER", together)
        made.clear()
        runs = list(repeats.runs_of_all(texts, rule, powers))
        got = [tuple(int(run[c][j]) for c in ("doc", "full", "g", "at", "span", "spot")) for run in runs for j in range(len(run["at"]))]
        assert got == alone and 0 < len(made) <= passes
