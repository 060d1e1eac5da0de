"""Line dedup against brute force, with planted odd rows."""

import hashlib
import random

import pytest

from tickloom.llm import lines

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """``(id, n_lines, n_dropped, text)`` by a dictionary of keys; null ids are one document after all others."""
    keyed = [(i, [(x, x.strip(SPACE).translate(LOWER)) for x in (t or "").split("\n")]) for i, t in rows]
    holders = {}
    for i, held in keyed:
        for _, key in held:
            if len(key) >= 10:
                holders.setdefault(key, set()).add(i)
    order = lambda i: (i is None, i or 0)
    out = []
    for i, held in keyed:
        kept = [x for x, key in held if len(key) < 10 or len(holders[key]) < 2 or min(holders[key], key=order) == i]
        out.append((i, len(held), len(held) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(5)
    pool = [f"Common line number {k} Été" for k in range(30)] + ["short", "", "  ", "é" * 9, "é" * 10, "É" * 10, "tenletters", " TENletters\t"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(12)))) for i in range(300)]
    rows += [(1000 + i, "the hot line of all\nown line of " + str(i)) for i in range(150)]
    return [*rows, (7, rows[7][1]), (7, "tenletters\nanother row of one id"), (None, "tenletters\nonly null ids hold this"),
            (None, "only null ids hold this"), (2000, None), (2001, ""), (2002, "x" * 400_000 + "\n" + "the hot line of all\r")]


@pytest.mark.parametrize("share", [lines.SHARE, 0.05])
def test_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(lines, "SHARE", share)
    rows = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = plain(rows)
    counts = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in lines.line_counts(docs).collect()), key=repr)
    assert counts == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in wanted), key=repr)


def test_texts_nulls_and_clashing_columns(spark):
    rows = [(2, "Same line here\nb", 1, "x"), (1, "same line here ", 2, None), (3, None, 3, "y"), (4, "SAME LINE HERE", None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places int, __tag string").withColumnRenamed("__tag", "__id")
    made = lines.without_shared_lines(docs)
    assert made.columns == docs.columns
    assert sorted(tuple(r) for r in made.collect()) == [(1, "same line here ", 2, None), (2, "b", 1, "x"), (3, None, 3, "y"), (4, "", None, "z")]
    assert lines.without_shared_lines(docs.limit(0)).count() == 0
    assert lines.line_counts(docs.limit(0)).count() == 0


def test_thresholds(spark):
    docs = spark.createDataFrame([(i, "abcdef") for i in range(3)], "doc_id long, text string")
    left = lambda **k: sorted(r.text for r in lines.without_shared_lines(docs, **k).collect())
    assert left() == ["abcdef"] * 3
    assert left(least_chars=6) == ["", "", "abcdef"]
    assert left(least_chars=6, least_docs=4) == ["abcdef"] * 3
