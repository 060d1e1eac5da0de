"""Groups of near copies against brute-force Jaccard, and planted odd cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tickloom.llm import nearcopies, simhash
from tickloom.llm.common import read_table


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_least(rows):
    """Least id of the group of every id, by the similarity of all pairs that share a shingle."""
    sets = {r.doc_id: plain_set(r.text) for r in rows}
    holders, parent = defaultdict(list), {i: i for i in sets}
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = 0
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in holders[s] if j < i).items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                pairs += sets[i] != sets[j]
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in sets}, pairs


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_equals_brute_force_jaccard(spark, size):
    docs = read_table(spark, f"/root/testdata/{size}", "documents")
    least, pairs = plain_least(docs.collect())
    assert pairs >= 12 or size == "sf0.001"
    got = sorted(r.doc_id for r in cp.near_duplicates(spark, docs, "").collect())
    assert got == sorted(set(least.values()))


def test_chains_short_texts_and_odd_rows(spark):
    words = [f"w{i}" for i in range(100)]
    step = lambda n: " ".join(f"x{i}" if i < n else w for i, w in enumerate(words))
    rows = [(5, step(0)), (4, step(6)), (3, step(12)), (2, step(60)), (8, "one two"), (7, "ONE\ttwo"), (9, "two one"),
            (11, None), (10, ""), (10, ""), (None, "alone here"), (None, step(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in nearcopies.one_of_each(docs).collect()), key=repr)
    assert got == sorted([(3, step(12)), (2, step(60)), (7, "ONE\ttwo"), (9, "two one"), (10, ""), (None, "alone here")], key=repr)
    assert nearcopies.one_of_each(docs.limit(0)).count() == 0


def varied(seed, n):
    """Texts made from a few others by changing some words, at all similarities from a half to one."""
    rng = random.Random(seed)
    made = [" ".join(f"b{k}x{i}" for i in range(60)) for k in range(4)]
    while len(made) < n:
        words = rng.choice(made).split()
        for _ in range(rng.choice([1, 1, 2, 3, 5])):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        made.append(" ".join(words))
    return [(i, t) for i, t in enumerate(rng.sample(made, n))]


@pytest.mark.parametrize("members", [1024, 4])
def test_varied_texts_equal_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(nearcopies, "MEMBERS", members)
    docs = spark.createDataFrame(varied(members, 300), "doc_id long, text string")
    least, pairs = plain_least(docs.collect())
    got = sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect())
    assert got == sorted(set(least.values())) and pairs > 100 and 4 < len(got) < 290


def test_a_chain_of_two_thousand_texts_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "MEMBERS", 64)
    rows = [(i, " ".join(f"w{j}" for j in range(3 * i, 3 * i + 60))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert [r.doc_id for r in nearcopies.one_of_each(docs).collect()] == [0]
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("tag"), F.col("text").cast("binary").alias("text"))
    sets = nearcopies.signed(keyed).withColumn("many", F.lit(False)).checkpoint()
    pairs = sets.select(F.col("fp").alias("u"), F.first("fp").over(Window.partitionBy().orderBy("id")).alias("v")).where("u != v").checkpoint()
    dealt = nearcopies.similar_pairs(pairs, sets, keyed)
    assert pairs.count() == 1999 and dealt.count() == sum(3 * i <= 6 for i in range(1, 2000))


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 5, "x"), (2, "A b c d e f", 6, None), (3, "other words", None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, id string").withColumnRenamed("fp", "tag")
    got = nearcopies.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]


def test_simhash_deals_candidates_before_minhash(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
    texts = {i: " ".join([*base[:-i], *(f"e{i}x{k}" for k in range(i))] if i else base) for i in range(4)}
    texts |= {9: " ".join(f"o{i}" for i in range(300)), 10: None, 11: ""}
    held = {i: nearcopies.shingles((t or "").encode()) for i, t in texts.items()}
    prints = {i: simhash.majority(s) for i, s in held.items()}
    close = [(i, j) for i in range(4) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS]
    assert len(close) == 6 and prints[10] == 0
    keyed = spark.createDataFrame([(i, i, (t or "").encode()) for i, t in texts.items()], "id long, tag long, text binary")
    sets = nearcopies.signed(keyed).checkpoint()
    assert {r.id: r["print"] & (1 << 64) - 1 for r in sets.collect()} == prints
    names = {r.fp: r.id for r in sets.collect()}
    pairs = [{names[r.u], names[r.v]} for r in nearcopies.print_pairs(sets).collect()]
    assert len(pairs) >= 3 and set.union(*pairs) == {0, 1, 2, 3}
    # SimHash alone joins these where no band is left to meet in.
    empty = spark.createDataFrame([], "fp long, band long")
    monkeypatch.setattr(nearcopies, "banded", lambda _: empty)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect()) == [0, 9, 10]
