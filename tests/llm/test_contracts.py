"""The registered queries: columns, one row for each document or page, and what each result must satisfy."""

import pytest

import __spark_entry__ as entry
from tickloom.llm.common import read_table

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_license_scan": ["doc_id", "license", "coverage", "n_matched", "first_word", "end_word"],
    "op4_benchmark_decontamination": ["doc_id", "item_id", "distance", "span_end", "n_found"],
    "op5_exact_top_k": ["query_id", "rank", "vec_id", "score"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "sound"],
    "op7_simhash_near_dedup": ["doc_id", "fingerprint", "component_id"],
    "op8_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op9_quality_classifier": ["doc_id", "log_weight", "sample_key", "selected"],
    "op10_source_mixing": ["doc_id", "n_tokens", "p_toxic", "p_good", "p_plain", "rate"],
    "op11_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op12_phrase_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13_lexical_search": ["item_id", "rank", "doc_id", "score"],
}
A_ROW_EACH = {n for n in COLUMNS if n.split("_")[0] in ("op1", "op2", "op7", "op8", "op9", "op10", "op11")}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    made = entry.queries()[name](spark, SMALL)
    assert made.columns == COLUMNS[name]
    rows = made.collect()
    assert rows
    if name in A_ROW_EACH:
        ids = [r.doc_id for r in read_table(spark, SMALL, "documents").select("doc_id").collect()]
        assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name == "op6_warc":
        assert all(r.sound for r in rows)


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries()
    assert set(COLUMNS) | {"pipeline"} <= set(names)
    assert {n for n in names if n.startswith("op") and n[2].isdigit()} == set(COLUMNS)
