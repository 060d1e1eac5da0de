"""The stages against brute force on small tables, and the whole run."""

import numpy as np
import pytest
from pyspark.sql import Row

import corpus_pipeline as cp
from test_nearcopies import plain_least
from tickloom.llm import decontaminate, langid, mixing
from tickloom.llm.common import read_table, written

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Documents, then what every stage returns, each written and read again."""
    docs = read_table(spark, SMALL, "documents")
    odd = [(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "1 2 3", "en", None, None), (None, "the and of the " * 40, "en", "s", 1)]
    made = [docs.union(spark.createDataFrame(odd, docs.schema))]
    for name, stage in cp.STAGES:
        made.append(written(stage(spark, made[-1], SMALL), f"test-{name}"))
    return made


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns(steps):
    for made in steps[1:-1]:
        assert made.schema == steps[0].schema
    assert steps[-1].columns == [*steps[0].columns, "n_tokens", "p_toxic", "p_good", "p_plain", "rate"]


def test_language_keeps_what_the_model_supports(steps):
    docs, kept = steps[0], steps[1]
    done = langid.predict(docs, langid.fit(docs)).where("lang_pred != 'und' and score >= 0.2")
    assert rows(kept) == rows(done.select(*docs.columns))
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert {9001, 9002, 9003} <= lost and len(lost) <= 5


def test_one_document_of_each_group(steps):
    held = sorted(steps[1].collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    least, _ = plain_least([Row(doc_id=i, text=r.text) for i, r in enumerate(held)])
    wanted = [r for i, r in enumerate(held) if least[i] == i]
    assert rows(steps[2]) == sorted((tuple(r) for r in wanted), key=repr)


def test_repeated_strings_are_cut(steps):
    seen, wanted = set(), []
    held = sorted(steps[2].collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    for r in held:
        data = r.text.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            s = data[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        text = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        wanted.append((r.doc_id, text, r.lang, r.source, len(text)))
    assert rows(steps[3]) == sorted(wanted, key=repr)


def test_leaks_go(spark, steps):
    items = [decontaminate.plain(r.text) for r in read_table(spark, SMALL, "benchmark").collect()]
    before, after = steps[3].collect(), {r.doc_id for r in steps[4].collect()}
    for r in before:
        text = decontaminate.plain(r.text)
        near = [decontaminate.nearest(decontaminate.letters(i), len(i), text, decontaminate.budget(i, decontaminate.ERROR_RATE)) for i in items]
        assert (r.doc_id in after) == (not any(near))
    assert len(after) < len(before)


def test_rates_mix(steps):
    made = steps[5].toPandas()
    assert (made.rate >= 0).all()
    assert rows(steps[5].select("doc_id")) == rows(steps[4].select("doc_id"))
    shares = made[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    np.testing.assert_allclose(shares.sum(axis=1), 1)


def test_run_is_the_stages_one_after_the_other(spark):
    made = cp.run(spark, SMALL)
    docs = read_table(spark, SMALL, "documents")
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, SMALL), "again")
    wanted = cp.STAGES[-1][1](spark, docs, SMALL)
    assert sorted(r.doc_id for r in made.collect()) == sorted(r.doc_id for r in wanted.collect())
    assert cp.run(spark, SMALL).count() == made.count() > 100


def test_empty_documents_pass_through(spark):
    docs = read_table(spark, SMALL, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() == 0
