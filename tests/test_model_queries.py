"""The model queries on a small history, with everything they say about their predictions true."""

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.operators.boosting import Settings
from tickloom.operators.pipeline import Recipe
from tickloom.plans import modelling

SMALL = "/root/testdata/sf0.01"
NAMES = ["train_primary", "oof_predictions", "score_signals", "model_backtest", "tune_grid", "importance_mdi", "model_registry", "train_meta", "importance_mda"]


def test_recipe_is_the_default():
    assert modelling.RECIPE == Recipe() and Recipe().settings == Settings()
    assert modelling.GRID[-1] == Settings()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(row[i] for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, monkeypatch, name):
    """Whole history, folds and depth; fewer rounds, since what is compared holds for any number."""
    few = Settings(trees=3)
    monkeypatch.setattr(modelling, "RECIPE", Recipe(settings=few))
    monkeypatch.setattr(modelling, "GRID", [Settings(trees=3, depth=2), few])
    made = entry.queries()[name](spark, SMALL)
    got = _rows(made.columns, [tuple(r) for r in made.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    told = con.execute(entry.oracle_sql()[name].replace("100 AS trees", "3 AS trees"))
    assert got == _rows([d[0] for d in told.description], told.fetchall())
    assert got[1]


@pytest.mark.parametrize("name", ["train_primary", "score_signals", "importance_mda"])
def test_a_short_history(spark, monkeypatch, name):
    """The smallest tables end before the longest feature begins: it is left out, and the rest is fitted."""
    monkeypatch.setattr(modelling, "RECIPE", Recipe(settings=Settings(trees=1)))
    made = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert made.columns and made.count() > 0
