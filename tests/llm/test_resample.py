"""Importance resampling against plain counts, and the exact cut."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import resample as rs
from tickloom.llm.common import id_and_text, read_table


def test_ratios_equal_plain_counts(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    labels = read_table(spark, "/root/testdata/sf0.001", "labels")
    good = rs.label_sample(labels, "quality = 1 AND toxic = 0", 30)
    assert len(good) == 30
    raw, target = np.ones(rs.BUCKETS), np.ones(rs.BUCKETS)
    for r in docs.collect():
        for b in rs.gram_buckets(r.text.encode()):
            raw[b] += 1
            target[b] += r.doc_id in good
    wanted = np.log(target / target.sum()) - np.log(raw / raw.sum())
    np.testing.assert_allclose(rs.log_ratios(id_and_text(docs, "doc_id", "text"), good), wanted)


@pytest.mark.parametrize("k", [0, 1, 7, 50, 99, 100, 140])
def test_kth_largest(spark, k):
    values = [math.sin(i) * 10 ** (i % 7) for i in range(80)] + [2.5] * 20
    cut = rs.kth_largest(spark.createDataFrame([(v,) for v in values], "x double"), "x", k)
    if k >= 100:
        assert cut is None
    elif k == 0:
        assert cut == (math.inf, 0)
    else:
        top = sorted(values, reverse=True)
        assert cut == (top[k - 1], k - sum(v > top[k - 1] for v in values))


def test_good_texts_win(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    made = rs.resample(docs, labels)
    table = made.join(labels, "doc_id").toPandas()
    share = labels.agg(F.avg(F.expr("int(quality = 1 and toxic = 0)"))).first()[0]
    n = docs.count()
    assert made.count() == n and made.where("selected").count() == round(n * share)
    good = table[(table.quality == 1) & (table.toxic == 0)]
    junk = table[(table.quality == 0)]
    assert good.selected.mean() > junk.selected.mean() + 0.3


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "c")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, selected boolean")
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (9, 1, 0), (4, 0, None)], "doc_id long, quality int, toxic int")
    got = rs.resample(docs, labels, fraction=0.5).collect()
    assert len(got) == 6 and sum(r.selected for r in got) == 3
    assert all(r.log_weight == 0 for r in got if r.doc_id in (1, 2))
    assert rs.resample(docs.limit(0), labels).count() == 0
    assert rs.resample(docs, labels.limit(0)).where("selected").count() == 6
