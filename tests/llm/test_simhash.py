"""SimHash links and components against all pairs, and planted odd cases."""

import random

import numpy as np
import pytest
import xxhash

from tickloom.llm import simhash
from tickloom.llm.common import read_table


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    array = np.array(prints, np.uint64)
    for i in range(len(array)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array[: i + 1]) <= 3):
            parent[find(i)] = find(int(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_documents_equal_brute_force(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    rows = docs.collect()
    wanted = plain_components([plain_print(r.text) for r in rows], [r.doc_id for r in rows])
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert len(got) == len(rows)
    for row, component in zip(rows, wanted):
        assert got[row.doc_id].component_id == component
        assert got[row.doc_id].fingerprint == f"{plain_print(row.text):016x}"


@pytest.mark.parametrize("split", [2048, 4])
def test_links_lose_no_pair(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = random.Random(5)
    values = {0}
    for _ in range(60):
        seed = rng.getrandbits(64)
        values.add(seed)
        for _ in range(12):
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            values.add(seed)
    prints = sorted(values)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    place = {v: i for i, v in enumerate(signed)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for u, v in found:
        assert bin((u ^ v) & (2**64 - 1)).count("1") <= 3
        parent[find(place[u])] = find(place[v])
    wanted = plain_components(prints, list(range(len(prints))))
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(
        [i for i, w in enumerate(wanted) if w == k] for k in sorted(set(wanted))
    )


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(None, None, 1), (7, None, 2), (3, "", 3), (3, "", 3), (5, "one two", 4), (6, "ONE\ttwo", 5), (None, "x y z w", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()), key=repr)
    assert got == sorted([(None, 3), (7, 3), (3, 3), (3, 3), (5, 5), (6, 5), (None, None)], key=repr)
    kept = simhash.one_of_each(docs.withColumnRenamed("component_id", "root"))
    assert sorted((r.doc_id, r.root) for r in kept.where("doc_id is not null").collect()) == [(3, 3), (5, 4)]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
