"""Rates: totals against targets, a plain solver, and the classifier on held-out labels."""

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import mixing
from tickloom.llm.common import read_table


def test_solver_meets_targets_and_equals_plain_steps(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.5, 0.7, 0.3], 400)
    n = rng.integers(0, 900, 400)
    rows = [(int(a), [float(x) for x in b]) for a, b in zip(n, p)]
    held = spark.createDataFrame(rows, "__tokens long, __p array<double>").repartition(5)
    targets = np.array([0.6, 0.3, 0.1])
    steps = mixing.solve_rates(held, targets, tolerance=1e-6)
    rate, _ = mixing.folded(p, steps)
    assert (rate >= 0).all()
    np.testing.assert_allclose((n * rate) @ p / n.sum(), targets, atol=1e-4)


def plain_totals(p, n, targets):
    """Totals of the least squares by many plain steps without momentum."""
    rate, length = np.ones(len(p)), 1 / np.linalg.eigvalsh((p.T * n) @ p).max()
    for _ in range(20_000):
        rate = np.maximum(0, rate - length * p @ ((n * rate) @ p - targets * n.sum()))
    return (n * rate) @ p


def test_targets_out_of_reach_get_as_near_as_they_can(spark):
    rng = np.random.default_rng(6)
    p, n = rng.dirichlet([2, 3, 4], 200), rng.integers(1, 500, 200)
    held = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p)], "__tokens long, __p array<double>")
    targets = np.array([0.0, 0.0, 1.0])
    rate, _ = mixing.folded(p, mixing.solve_rates(held, targets, passes=150, tolerance=1e-5))
    # The best rates pile up on the few most extreme documents, which any gradient method nears slowly.
    off = np.linalg.norm((n * rate) @ p / n.sum() - targets)
    assert off <= np.linalg.norm(plain_totals(p, n, targets) / n.sum() - targets) + 0.03
    assert (rate == 0).any()


def test_documents(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    made = mixing.mixed_rates(docs, labels).toPandas()
    assert len(made) == docs.count() and (made.rate >= 0).all()
    shares = made[["p_toxic", "p_good", "p_plain"]].to_numpy()
    np.testing.assert_allclose(shares.sum(axis=1), 1)
    got = (made.n_tokens * made.rate).to_numpy() @ shares / made.n_tokens.sum()
    assert np.abs(got - np.array([0, 0.9, 0.1])).max() < 0.03
    known = {i for i, _ in mixing.labelled_domains(labels, mixing.DOMAINS, mixing.SAMPLE_ROWS)}
    held = labels.toPandas().merge(made, on="doc_id")
    held = held[~held.doc_id.isin(known)]
    plain, good = held[held.quality == 0], held[(held.quality == 1) & (held.toxic == 0)]
    assert good.p_plain.mean() + 0.3 < plain.p_plain.mean() if len(plain) else True


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b c"), (3, "a b c"), (4, "d")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rate string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mixed_rates(docs, labels).collect()
    assert len(got) == 6 and all(r.rate >= 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    assert mixing.mixed_rates(docs.limit(0), labels).count() == 0
    uniform = mixing.mixed_rates(docs, labels.limit(0)).collect()
    assert len({tuple(round(x, 6) for x in (r.p_toxic, r.p_good, r.p_plain)) for r in uniform}) == 1
    kept = mixing.with_rates(docs, labels)
    assert kept.columns == ["doc_id", "text", "rate", "__tokens", "__p", "__rate"] and kept.count() == 6
    assert kept.where(F.col("__rate").isNull()).count() == 0
