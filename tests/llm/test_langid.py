"""Language prediction: held-out accuracy, the kernel against sets, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import langid
from tickloom.llm.common import read_table


def grams(text):
    b = text.encode().lower()
    return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def test_gram_set_equals_plain_sets():
    for text in ("", "a", "ab", "Abc abc", "größer"):
        assert len(langid.gram_set(text.encode())) == len(grams(text))


@pytest.fixture(scope="module")
def result(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    done = langid.identify(docs)
    return done.join(docs, "doc_id").select("doc_id", "held_out", "lang_pred", "score", "lang", "text").toPandas()


def test_held_out_accuracy(result):
    assert len(result) == 1000 and result.score.between(0, 1).all()
    held = result[result.held_out]
    assert 250 < len(held) < 420
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_scores_equal_the_kernel_taken_from_sets(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.fit(docs, landmarks=40)
    texts = [r.text for r in docs.limit(15).collect()]
    known = [{model.grams[j] for j in np.flatnonzero(m)} for m in model.marks]
    dictionary = set(model.grams.tolist())
    plain = np.array([[len(s & k) / max(1, (len(s) * len(k)) ** 0.5) for k in known] for s in
                      ({c for c in langid.gram_set(t.encode()).tolist()} & dictionary for t in texts)])
    got = model.scores([t.encode() for t in texts], model.lookup())
    np.testing.assert_allclose(got, plain @ model.weights + model.bias, rtol=1e-3, atol=1e-3)


def test_odd_rows(spark):
    rows = [(1, None, "en", 0.5), (2, "", "en", 0.5), (None, "12 ... 34", None, 1.0), (4, "the and", "en", 2.0), (4, "the and", "en", 2.0),
            (6, "der und die", "de", None), (7, "Ünd", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.text): r for r in langid.predict(docs, langid.fit(docs)).toDF(
        "doc_id", "text", "lang", "clash", "lang_pred", "score").collect()}
    assert got[(1, None)].lang_pred == got[(2, "")].lang_pred == got[(None, "12 ... 34")].lang_pred == "und"
    assert got[(4, "the and")].lang_pred == "en" and got[(6, "der und die")].lang_pred == "de"
    assert got[(7, "Ünd")].lang_pred in ("en", "de")
    assert langid.identify(docs).count() == 7
    assert langid.identify(docs.limit(0)).count() == 0
    nothing = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.keep_known(docs.drop("score")).where("text is null or text = ''").count() == 0


def test_unlearned_languages_and_noise_go_clean_texts_stay(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    odd = [(-1, "Городской совет вчера вечером решил построить новые школы у реки."),
           (-2, "市議会は昨夜、川の近くに新しい学校を建てることを決めた。"), (-3, "Δεν ξέρω τι θα γίνει αύριο το πρωί στην πόλη."),
           (-4, "a 12873 #### 9918273 ^^^^ 1827 %%"), (-5, "q9#8@1!")]
    planted = docs.unionByName(spark.createDataFrame([(i, t, None) for i, t in odd], docs.schema))
    kept = {r.doc_id for r in langid.keep_known(planted).select("doc_id").collect()}
    assert not any(i < 0 for i in kept)
    assert kept == {r.doc_id for r in langid.predict(docs, langid.fit(docs)).where("lang_pred != 'und'").collect()}
    for unlearned in ("es", "fr"):
        without = docs.withColumn("lang", F.when(F.col("lang") != unlearned, F.col("lang")))
        left = langid.keep_known(without).join(docs.withColumnRenamed("lang", "true").drop("text"), "doc_id")
        share = {r.true: r["count"] for r in left.groupBy("true").count().collect()}
        all_ = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
        assert share.get(unlearned, 0) < 0.1 * all_[unlearned]
        print(unlearned, share, all_)
        assert all(share[k] > 0.99 * all_[k] for k in all_ if k != unlearned)
