"""Edit matching against plain dynamic programming, and planted leaks."""

import random

import pytest

from tickloom.llm import decontaminate as dc
from tickloom.llm.common import read_table


def plain_nearest(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row), row.index(min(row))


@pytest.mark.parametrize("seed", range(8))
def test_myers_equals_plain(seed):
    rng = random.Random(seed)
    item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
    text = "".join(rng.choice("abc ") for _ in range(60)) + item[3:] + "".join(rng.choice("abc ") for _ in range(60))
    assert dc.nearest(dc.letters(item), len(item), text, len(item)) == plain_nearest(item, text)


def edited(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.random()
        if kind < 0.4:
            chars[at] = rng.choice("xyz")
        elif kind < 0.7:
            chars.insert(at, rng.choice("xyz"))
        else:
            del chars[at]
    return "".join(chars)


def test_every_planted_item_is_found_and_no_other(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eta", "iota", "kappa", "mu", "nu", "omicron"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(4, 30)))) for i in range(12)]
    docs = []
    for d in range(120):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        if d % 3 == 0:
            item = dc.plain(items[d % 12][1])
            text += " " + edited(rng, item, rng.randint(0, 3 + dc.budget(item, dc.ERROR_RATE))) + " " + rng.choice(words).upper() + "\n"
        docs.append((d, text))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, items[1][1].upper()), (502, items[1][1].upper())]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (None, "alpha"), (77, None), (78, "")], "item_id long, text string")
    wanted = []
    for doc, text in docs:
        for item_id, item in items:
            item, flat = dc.plain(item), dc.plain(text)
            distance, _ = plain_nearest(item, flat) if flat else (len(item), 0)
            if distance <= dc.budget(item, dc.ERROR_RATE):
                wanted.append((doc, item_id, distance))
    got = [(r.doc_id, r.item_id, r.distance) for r in dc.leaks(frame, bench).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    clean = {r.doc_id for r in dc.without_leaks(frame, bench).collect()}
    assert clean == {d for d, _ in docs} - {w[0] for w in wanted}
    assert dc.leaks(frame.limit(0), bench).count() == 0 and dc.leaks(frame, bench.limit(0)).count() == 0


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    docs, items = (read_table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, dc.leaks(docs, items).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 1500)
    assert sorted(map(tuple, dc.leaks(docs, items).collect())) == whole
    texts = {r.doc_id: r.text for r in docs.collect()}
    exact = {(d, r.item_id) for r in items.collect() for d, t in texts.items() if r.text in t}
    assert exact and exact <= {(d, i) for d, i, *_ in whole}
