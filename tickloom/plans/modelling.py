"""Queries that fit models, with the library's defaults, over a history of several years.

What a fit finds has no SQL form. The SQL holds the samples, folds, labels, volatilities and counts that go with it, and
what must be true of every prediction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators import features, labels, ledger, models, pipeline
from tickloom.operators.boosting import Settings
from tickloom.operators.features import FEATURES, FRACTIONAL_CUTOFF, FRACTIONAL_DEGREE, fractional_weights
from tickloom.plans import sql
from tickloom.plans.market_data import r
from tickloom.plans.registry import query
from tickloom.plans.research import PLAIN, ROUNDED, WHOLE_ROWS, all_features, rounded
from tickloom.session import fresh_path
from tickloom.sources.tables import bars_history

RECIPE = pipeline.Recipe()
GRID = [Settings(depth=2), Settings()]

# Bars before the first whole window of the longest feature.
WARM_UP = len(fractional_weights(FRACTIONAL_DEGREE, FRACTIONAL_CUTOFF)) - 1

HISTORY = (
    sql.LONG_WALK
    + f""",
clean AS MATERIALIZED (
  SELECT symbol, ts, uid, close, pos - {WARM_UP} AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM walk WHERE pos > {WARM_UP})"""
)


def _valued(source: str) -> str:
    return f""",
rets AS MATERIALIZED (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS pct FROM {source})""" + sql.ewm("v100", "rets", "pct", 100)


def _labelled(source: str) -> str:
    """Labels of the bars of ``source``. Prices move by a cent at least, far beyond the threshold on the return scale: every bar but the first is an event."""
    return f""",
ends AS (
  SELECT e.symbol, e.ts AS t0, e.close AS p0, v.vol, w.ts AS v1
  FROM {source} e JOIN v100 v ON v.symbol = e.symbol AND v.pos = e.pos AND v.vol IS NOT NULL
  ASOF JOIN {source} w ON w.symbol = e.symbol AND e.ts + INTERVAL 20 DAY <= w.ts),
touch AS MATERIALIZED (
  SELECT e.symbol, e.t0, e.p0, e.v1, min(CASE WHEN abs(ln(w.close / e.p0)) > 2.0::DOUBLE * e.vol THEN w.ts END) AS hit
  FROM ends e JOIN {source} w ON w.symbol = e.symbol AND w.ts BETWEEN e.t0 AND e.v1
  GROUP BY e.symbol, e.t0, e.p0, e.v1),
samples AS MATERIALIZED (
  SELECT t.symbol, t.t0, w.ts AS t1, CAST(sign(w.close / t.p0 - 1) AS INTEGER) AS bin
  FROM touch t JOIN {source} w ON w.symbol = t.symbol AND w.ts = coalesce(t.hit, t.v1))"""


SAMPLES = HISTORY + _valued("clean") + _labelled("clean")

SLICE = (
    HISTORY
    + """,
slice AS MATERIALIZED (
  SELECT symbol, ts, uid, close, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS pos, count(*) OVER (PARTITION BY symbol) AS size
  FROM clean WHERE pos > floor(n * 0.8::DOUBLE))"""
    + _valued("slice")
)


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    frame = pipeline.feature_frame(bars_history(spark, sf_dir), RECIPE)
    return pipeline.training_samples(frame, RECIPE), pipeline.usable_features(frame)


@query(
    "features_at_events",
    sql.ask(
        sql.on_history(all_features(FRACTIONAL_CUTOFF)) + sql.ewm("v100", "rets", "pct", 100) + _labelled("walk"),
        f"""SELECT s.symbol, s.t0, s.bin, {', '.join(f'f.{c}' for c in PLAIN)}, {rounded(6, *ROUNDED)}
        FROM samples s JOIN (SELECT * FROM allf WHERE {WHOLE_ROWS}) f ON f.symbol = s.symbol AND f.ts = s.t0""",
    ),
)
def features_at_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = labels.valued(bars_history(spark, sf_dir))
    made = features.clean_features(features.generate_features(frame))
    events = labels.cusum_events(frame, labels.cusum_threshold(frame)).select("symbol", F.col("ts").alias("t0"))
    joined = labels.features_at_events(labels.triple_barrier_labels(frame, events), made)
    have = set(joined.columns)
    return joined.select("symbol", "t0", "bin", *(c for c in PLAIN if c in have), *(r(c) for c in ROUNDED if c in have))


def _sure(prob: Column) -> Column:
    """Whether probabilities are between 0 and 1 and sum to 1."""
    total = F.aggregate(prob, F.lit(0.0), lambda a, x: a + x)
    return (F.abs(total - 1) < 1e-9) & F.forall(prob, lambda x: (x >= 0) & (x <= 1))


@query("train_primary", sql.ask(SAMPLES, "SELECT symbol, t0, bin, true AS known, true AS sure, true AS learned FROM samples"))
def train_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with its label; predictions are among the labels, probabilities sum to 1, and hits beat the commonest label."""
    samples, names = _samples(spark, sf_dir)
    model = models.fit_primary(samples, names, settings=RECIPE.settings)
    out = models.reliable(model.predict(models.as_doubles(samples, names), prob="prob").select("symbol", "t0", "bin", "pred", "prob"))
    whole = W.partitionBy()
    shares = out.groupBy("bin").agg(F.count("*").alias("n"), F.sum((F.col("bin") == F.col("pred")).cast("long")).alias("hits"))
    learned = shares.agg((F.sum("hits") > F.max("n")).alias("learned"))
    return out.join(learned).select("symbol", "t0", "bin", F.col("pred").isin(model.classes).alias("known"), _sure(F.col("prob")).alias("sure"), "learned")


@query(
    "oof_predictions",
    sql.ask(SAMPLES, "SELECT symbol, t0, bin, CAST(ntile(5) OVER (ORDER BY t0, symbol) - 1 AS INTEGER) AS fold, true AS known, true AS sure FROM samples"),
)
def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample once, with the fold that tests it."""
    samples, names = _samples(spark, sf_dir)
    out = models.out_of_fold(samples, names, RECIPE.settings)
    return out.select("symbol", "t0", "bin", "fold", F.col("pred").isin(-1, 0, 1).alias("known"), _sure(F.col("prob")).alias("sure"))


@query("train_meta", sql.ask(SAMPLES, "SELECT symbol, t0, true AS between FROM samples"))
def train_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second model's confidence, strictly between 0 and 1, for every sample."""
    samples, names = _samples(spark, sf_dir)
    oof = models.reliable(models.out_of_fold(samples, names, RECIPE.settings))
    meta = models.fit_meta(samples, oof, names)
    scored = models.score_signals(samples, models.Primary(names, [0]), meta)
    return scored.select("symbol", "t0", ((F.col("conf") > 0) & (F.col("conf") < 1)).alias("between"))


@query(
    "score_signals",
    sql.ask(
        SLICE,
        """SELECT s.symbol, s.ts, s.uid, s.close, round(v.vol, 10) AS vol, true AS known, true AS between
        FROM slice s LEFT JOIN v100 v USING (symbol, pos) WHERE s.size >= 100""",
    ),
)
def score_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test slice with its volatility; signals are labels, confidences probabilities."""
    frame = pipeline.feature_frame(bars_history(spark, sf_dir), RECIPE)
    book = pipeline.scored_slice(frame, pipeline.train(frame, RECIPE), RECIPE)
    known, between = F.col("signal").isin(-1, 0, 1), F.col("conf").between(0, 1)
    return book.select("symbol", "ts", "uid", "close", F.round("vol", 10).alias("vol"), known.alias("known"), between.alias("between"))


@query(
    "model_backtest",
    sql.ask(
        SLICE,
        f"""SELECT symbol, t.threshold, round(arg_max(close, pos) / arg_min(close, pos) - 1, 10) AS hold, true AS sound
        FROM slice, (SELECT unnest({list(ledger.THRESHOLDS)})::DOUBLE AS threshold) t WHERE size >= 100 GROUP BY symbol, t.threshold""",
    ),
)
def model_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return of holding for every symbol and threshold; metrics of the trades, where there are any, keep to their ranges."""
    frame = pipeline.feature_frame(bars_history(spark, sf_dir), RECIPE)
    trained = pipeline.train(frame, RECIPE)
    book = models.reliable(pipeline.scored_slice(frame, trained, RECIPE))
    metrics = ledger.trade_metrics(ledger.trade_ledger(book))
    levels = F.explode(F.array(*map(F.lit, ledger.THRESHOLDS))).alias("threshold")
    every = ledger.buy_and_hold(book).select("symbol", levels, F.round("bh_return", 10).alias("hold"))
    sound = F.col("trades").isNull() | (F.col("win_rate").between(0, 1) & (F.col("cum_ret") > -1) & (F.col("trades") > 0))
    return every.join(metrics, ["symbol", "threshold"], "left").select("symbol", "threshold", "hold", sound.alias("sound"))


@query("tune_grid", sql.ask(SAMPLES, "SELECT t.depth, 100 AS trees, 0.05::DOUBLE AS rate, true AS scored FROM (SELECT unnest([2, 4]) AS depth) t WHERE EXISTS (FROM samples)"))
def tune_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both settings with a score between 0 and 1."""
    samples, names = _samples(spark, sf_dir)
    found = models.tune_grid(samples, names, GRID)
    return found.select("depth", "trees", "rate", F.col("f1").between(0.2, 1).alias("scored"))


NAMED = f"FROM (SELECT unnest({list(FEATURES)}) AS feature) t WHERE EXISTS (FROM samples)"


@query("importance_mdi", sql.ask(SAMPLES, f"SELECT feature, true AS share, 1.0::DOUBLE AS total {NAMED}"))
def importance_mdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of all features, which sum to 1."""
    samples, names = _samples(spark, sf_dir)
    found = models.importance_mdi(spark, models.fit_primary(samples, names, settings=RECIPE.settings))
    total = found.agg(F.round(F.sum("importance"), 9).alias("total"))
    return found.join(total).select("feature", F.col("importance").between(0, 1).alias("share"), "total")


@query("importance_mda", sql.ask(SAMPLES, f"SELECT feature, true AS scored {NAMED}"))
def importance_mda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss between -1 and 1, with its deviation over the folds, for every feature."""
    samples, names = _samples(spark, sf_dir)
    found = models.importance_mda(samples, names, RECIPE.settings)
    return found.select("feature", (F.col("importance").between(-1, 1) & (F.col("deviation") >= 0)).alias("scored"))


VERSIONS = ["2024-01-30_0900", "2024-01-31_0900"]


@query(
    "model_registry",
    sql.ask(SAMPLES, f"SELECT 'pooled' AS name, '{VERSIONS[1]}' AS version, count(*) AS samples, count(*) AS scored, count(*) AS same FROM samples"),
)
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save two versions, load the newer one, and count on how many samples it says what was saved."""
    samples, names = _samples(spark, sf_dir)
    root = fresh_path(spark, "models")
    size = samples.count()
    saved = models.fit_settings(samples, names, GRID)
    for version, primary in zip(VERSIONS, saved):
        models.save_bundle(spark, root, "pooled", version, primary, None, size)
    loaded, _ = models.load_bundle(spark, [f"{root}-absent", root], "pooled")
    both = loaded.predict(saved[-1].predict(models.as_doubles(samples, names), "was", "was_prob"), "is", "is_prob")
    counted = both.agg(F.count("is").alias("scored"), F.sum((F.col("was_prob") == F.col("is_prob")).cast("long")).alias("same"))
    return models.registry(spark, root).select("name", "version", "samples").join(counted)
