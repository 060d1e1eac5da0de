"""Lexical search against a plain ranking; trees against dense grids."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import treap

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k=20):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        wanted, found = Counter(terms(text)), []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in wanted.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -score) for rank, (score, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def fixture():
    rng = random.Random(8)
    pool = [f"t{i}" for i in range(60)] + ["Été", "ÉTÉ", "naïve", "x_y", "rare" + "z"]
    text = lambda n: " ".join(rng.choice(pool[: rng.randrange(5, 66)]) for _ in range(n))
    docs = [(rng.randrange(1000), text(rng.randrange(30))) for _ in range(200)]
    docs += [(5000 + i, "same text of many copies") for i in range(90)]
    docs += [(1, "t1 t2"), (1, "t1 t2"), (None, "same text of many copies"), (None, "t3"), (9000, None), (9001, "..."), (9002, text(20000))]
    items = [(i, text(rng.randrange(1, 15))) for i in range(30)] + [(7, "same copies"), (7, "same copies"), (8, "t1 t1 t1 t2"), (9, None), (10, "?"), (11, "unknown"), (None, "t5 t9")]
    return docs, items


@pytest.mark.parametrize("shard, group, k", [(4096, 200_000, 20), (7, 20, 20), (50, 60, 3)])
def test_equals_plain_ranking(spark, monkeypatch, shard, group, k):
    monkeypatch.setattr(treap, "SHARD_DOCS", shard)
    monkeypatch.setattr(treap, "GROUP_TERMS", group)
    docs, items = fixture()
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = treap.build_index(table)
    assert index.shards.count() >= len(docs) // shard
    made = sorted((tuple(r) for r in treap.search(index, asked, k).collect()), key=repr)
    assert made == plain(docs, items, k)


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 0), (2, "b", None, 1)], "doc_id long, text string, q string, score int")
    items = spark.createDataFrame([("i", "b a", 3)], "item_id string, text string, rank int")
    index = treap.build_index(docs)
    made = treap.search(index, items)
    assert made.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((r.item_id, r.rank, r.doc_id) for r in made.collect()) == [("i", 1, 1), ("i", 2, 2)]
    assert treap.search(index, items.limit(0)).count() == 0
    empty = treap.build_index(docs.limit(0))
    assert (empty.documents, empty.terms) == (0, 0) and treap.search(empty, items).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_dense_grid(monkeypatch, seed):
    monkeypatch.setattr(treap, "FRONT", 4)
    rng = np.random.default_rng(seed)
    shape = [(1, 1), (3, 70), (90, 5), (33, 64), (2, 2), (200, 300)][seed]
    grid = rng.integers(1, 50, shape) * (rng.random(shape) < 0.2)
    grid[0, 0] = 9
    rows, columns = np.nonzero(grid)
    tree = treap.Treap.unpacked(treap.Treap.of(rows, columns, grid[rows, columns]).packed())
    for _ in range(20):
        asked = np.unique(rng.integers(0, shape[0], rng.integers(1, 8)))
        weights = rng.integers(0, 4, len(asked))
        scores = (grid[asked] * weights[:, None]).sum(axis=0)
        order = [c for c in np.lexsort((np.arange(shape[1]), -scores)).tolist() if scores[c] > 0][:5]
        got = tree.best(asked, weights, 5)
        assert got[0].tolist() == order and got[1].tolist() == scores[order].tolist()


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(treap, "CHUNK", 7)
    text = "Alpha beta-gamma été 12x " * 20
    assert [t.decode() for part in treap.term_runs(text.encode()) for t in part] == terms(text)
