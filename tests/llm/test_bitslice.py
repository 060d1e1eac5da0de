"""Top products of the sliced index against plain sums."""

import numpy as np
import pytest

from tickloom.llm import bitslice


def plain(ids, values, query_id, query, k):
    scores = values @ query
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != query_id][:k]
    return [(int(ids[i]), int(scores[i])) for i in order]


@pytest.mark.parametrize("span", [1, 3, 40, 5000])
def test_block_equals_plain(span):
    rng = np.random.default_rng(span)
    ids, values = rng.permutation(400)[:300].astype(np.int64), rng.integers(-span, span + 1, (300, 7))
    block = bitslice.SlicedBlock(ids, values)
    for q in range(40):
        got = sorted(zip(*(x.tolist() for x in block.top(int(ids[q]), values[q], 5))), key=lambda p: (-p[1], p[0]))
        assert got == plain(ids, values, ids[q], values[q], 5)


def test_small_blocks_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 256], 1) for i in range(90)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan"), 0.0, 0.0, 0.0], 1), (203, [float("inf")] * 4, 1),
             (None, [0.0] * 4, 1), (50, rows[3][1], 1), (250, [1.0, 2.0], 1), (251, [], 1), (300, [], 1), (7, rows[7][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    vectors = bitslice.whole_vectors(table, "vec_id", "embedding")
    asked = vectors.where("id % 50 = 0")
    held = [(r.id, np.array(r.v, np.int64)) for r in vectors.collect()]
    wanted = set()
    for query_id, query in {(i, tuple(v)) for i, v in held if i % 50 == 0}:
        same = [(i, v) for i, v in held if len(v) == len(query)]
        values = np.array([v for _, v in same]).reshape(len(same), len(query))
        best = plain(np.array([i for i, _ in same]), values, query_id, np.array(query, np.int64), 5)
        wanted |= {(query_id, n, i, s, query) for n, (i, s) in enumerate(best, 1)}
    got = bitslice.top_products(asked, vectors, 5, block=16, query_block=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(w[:4] for w in wanted)
    assert bitslice.top_products(asked.limit(0), vectors).count() == 0
    assert bitslice.top_products(asked, vectors.limit(0)).count() == 0
