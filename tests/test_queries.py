"""Every named query against its SQL, and the entry point."""

import pytest

import __spark_entry__ as spark_entry
from check import compare, database, table

SMALL = "/root/testdata/sf0.001"
# These need more bars per symbol than the smallest tables have.
LARGER = {"clean_features", "generate_features", "frac_diff", "bars_for_features", "features_at_events"}
# Fits, compared with few rounds in test_model_queries.
FITS = {"train_primary", "oof_predictions", "score_signals", "model_backtest", "tune_grid", "importance_mdi", "model_registry", "train_meta", "importance_mda"}


@pytest.fixture(scope="module")
def con():
    return database(SMALL)


@pytest.fixture(scope="module")
def larger_con():
    return database("/root/testdata/sf0.01")


def test_entry(spark):
    df = spark_entry.entry(spark)
    assert df.columns == ["symbol", "ts", "open", "high", "low", "close", "volume", "vwap"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(set(spark_entry.oracle_sql()) - FITS))
def test_query_equals_sql(spark, con, larger_con, name):
    sf_dir, db = ("/root/testdata/sf0.01", larger_con) if name in LARGER else (SMALL, con)
    df = spark_entry.queries()[name](spark, sf_dir)
    result = db.execute(spark_entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert compare(table(df.columns, df.collect()), table(names, result.fetchall())) is None
