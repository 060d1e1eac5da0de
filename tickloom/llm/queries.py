"""The corpus queries by name, each over the whole of its table, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import bitslice, collocations, decontaminate, langid, licenses, lines, mixing, phrases, resample, simhash, substrings, treap, warc
from tickloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


@query(
    "op2_substring_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
    ), w AS (
        SELECT doc_id, p, array_to_string(words[p:p + 34], ' ') AS s
        FROM d, unnest(generate_series(1, len(words) - 34)) t(p)
    ), f AS (
        SELECT doc_id, p, count(*) OVER (PARTITION BY s) > 1 AS again FROM w
    ), u AS (
        SELECT d.doc_id, q, words[q] AS word,
               coalesce(bool_or(f.again) OVER (PARTITION BY d.doc_id ORDER BY q ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
        FROM d CROSS JOIN unnest(generate_series(1, len(words))) t(q) LEFT JOIN f ON f.doc_id = d.doc_id AND f.p = q
    ), g AS (
        SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (NOT gone) AS kept
        FROM u GROUP BY doc_id
    )
    SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
           sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN g USING (doc_id)
    """,
)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.cut_counts(read_table(spark, sf_dir, "documents"))


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(read_table(spark, sf_dir, "documents"))


@query("op4_benchmark_decontamination")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query(
    "op5_exact_top_k",
    """
    WITH v AS (
        SELECT vec_id, [CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT) for x in embedding] AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               CAST(list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM scored
    QUALIFY rank <= 5
    """,
)
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = bitslice.whole_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return bitslice.top_products(vectors.where("id % 50 = 0"), vectors, 5)


@query(
    "op6_warc",
    """
    WITH p AS (
        SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
               sha1(coalesce(html, '')) AS payload_digest
        FROM pages
    ), t AS (
        SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p
    )
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to,
           true AS sound
    FROM t
    """,
)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


@query("op7_simhash_near_dedup")
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


# In SQL a row for each byte with its text takes minutes and ten gigabytes on 1,000 documents: tests compare with brute force.
@query("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_lengths(read_table(spark, sf_dir, "documents"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op10_source_mixing")
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query(
    "op11_line_dedup",
    """
    WITH s AS (
        SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS space
    ), d AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), l AS (
        SELECT doc_id, p, lines[p] AS line,
               translate(trim(lines[p], space), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM d CROSS JOIN s CROSS JOIN unnest(generate_series(1, len(lines))) t(p)
    ), k AS (
        SELECT key, min(doc_id) AS lead FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > lead) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (lead IS NULL OR doc_id = lead), '')) AS kept_sha256
    FROM l LEFT JOIN k USING (key)
    GROUP BY doc_id
    """,
)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_counts(read_table(spark, sf_dir, "documents"))


@query(
    "op12_phrase_collocations",
    r"""
    WITH p AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), w AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
    ), g AS (
        SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase
        FROM (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w) CROSS JOIN generate_series(1, 4) t(size)
        WHERE i + size <= len(ws) + 1
    ), f AS MATERIALIZED (
        SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
    ), c AS (
        SELECT lang, phrase, size, f, string_split(phrase, ' ') AS ws FROM f WHERE size > 1
    ), part AS MATERIALIZED (
        SELECT lang, phrase, f, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest
        FROM c CROSS JOIN generate_series(1, 3) t(k) WHERE k < size
    ), cut AS (
        SELECT p.lang, p.phrase, p.f AS a, l.f AS l, r.f AS r, 2000000::HUGEINT * p.f // (l.f + r.f) AS score
        FROM part p
        JOIN f l ON l.lang = p.lang AND l.phrase = p.first
        JOIN f r ON r.lang = p.lang AND r.phrase = p.rest
        QUALIFY row_number() OVER (PARTITION BY p.lang, p.phrase ORDER BY score, k) = 1
    ), inside AS (
        SELECT lang, array_to_string(ws[i:i + s - 1], ' ') AS phrase, max(f) AS longer
        FROM c CROSS JOIN generate_series(2, 3) t(s) CROSS JOIN unnest(generate_series(1, c.size - s + 1)) u(i)
        WHERE s < c.size GROUP BY ALL
    ), n AS (
        SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
           phrase, a, l, r, n, CAST(score AS BIGINT) AS score
    FROM cut LEFT JOIN inside USING (lang, phrase) JOIN n USING (lang)
    WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
    QUALIFY rank <= 2000
    """,
)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


@query(
    "op13_lexical_search",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
        FROM documents
    ), s AS (
        SELECT count(*) AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0
    ), tf AS (
        SELECT doc_id, len(ts) AS n, term, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS term FROM d) GROUP BY ALL
    ), df AS (
        SELECT term, count(*) AS df FROM tf GROUP BY term
    ), q AS (
        SELECT item_id, term, count(*) AS repeats
        FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
        GROUP BY ALL
    ), scored AS (
        SELECT item_id, doc_id,
               sum(repeats * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                   * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN s
        GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
           doc_id, CAST(score AS BIGINT) AS score
    FROM scored WHERE score > 0
    QUALIFY rank <= 20
    """,
)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = treap.build_index(read_table(spark, sf_dir, "documents"))
    return treap.search(index, read_table(spark, sf_dir, "benchmark"))
