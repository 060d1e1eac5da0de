"""A corpus pipeline of five stages, each of which works on all that the one before it kept.

Language ID, one document of each group of near copies, byte strings that occur earlier cut out, documents with
benchmark items dropped, and rates that mix the rest to target weights. All stages but the last return
the columns of ``documents``; the last adds tokens, domain posteriors and the rate of each document (0: never drawn).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, langid, mixing, nearcopies, substrings
from tickloom.llm.common import read_table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those in a language that was not learned."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of texts whose five-word shingles are 0.8 similar."""
    return nearcopies.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes that occur earlier out of the texts; ``n_chars`` follows the text."""
    cut = substrings.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its error budget."""
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the rate that brings the expected tokens of the domains to their targets."""
    made = mixing.with_rates(docs, read_table(spark, sf_dir, "labels"))
    shares = [F.col("__p")[i].alias(f"p_{name}") for i, name in enumerate(mixing.DOMAINS)]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return made.select(*columns, F.col("__tokens").alias("n_tokens"), *shares, F.col("__rate").alias("rate"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("benchmark_decontamination", benchmark_leaks),
    ("target_mixing", target_mix),
]

# Hash kernels, edit distances and regressions have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
