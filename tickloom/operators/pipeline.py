"""Whole runs: ticks to bars, bars to samples, samples to models, models to trades."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import cv, labels, ledger, quality
from tickloom.operators import bars as bar_ops
from tickloom.operators.features import (
    FEATURES,
    FRACTIONAL_CUTOFF,
    FRACTIONAL_DEGREE,
    clean_features,
    generate_features,
    with_volatility,
)
from tickloom.operators.boosting import Settings
from tickloom.operators.models import Primary, fit_folds, fit_meta, score_signals
from tickloom.operators.ordered import small_side, split
from tickloom.session import reliable

LEAST_TEST_ROWS = 100


def build_bars(ticks: DataFrame, expected_ticks: float = bar_ops.EXPECTED_TICKS) -> DataFrame:
    """Threshold per symbol, then bars; a hot symbol is cut once for both.

    The first bar of a time stays, as ticks may share one.
    """
    cut = split(ticks.select("symbol", "ts", "uid", "price", "volume"), bar_ops.KEYS, bar_ops.ORDER)
    bars = bar_ops.dollar_imbalance_bars(cut, bar_ops.imbalance_threshold(cut, expected_ticks), one_per_time=True)
    return bars.withColumn("uid", F.lit(0).cast("long"))


@dataclass(frozen=True)
class Recipe:
    degree: float = FRACTIONAL_DEGREE
    cutoff: float = FRACTIONAL_CUTOFF
    days: int = labels.HORIZON_DAYS
    settings: Settings = Settings()
    test: float = cv.TEST_SHARE


@dataclass
class Trained:
    """Both models; without any sample ``primary`` has no class. ``gates`` says for each symbol whether it was learned from, or why not."""

    features: list[str]
    primary: Primary
    meta: PipelineModel | None
    samples: int
    gates: DataFrame

    @property
    def success(self) -> bool:
        return self.samples > 0


def feature_frame(bars: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Clean features, written once, by ``clean_features``: events, labels, training and scoring all read them."""
    return clean_features(generate_features(bars, recipe.degree, recipe.cutoff))


def usable_features(features: DataFrame) -> list[str]:
    return [c for c in FEATURES if c in features.columns]


def gated_samples(features: DataFrame, recipe: Recipe = Recipe()) -> tuple[DataFrame, DataFrame]:
    """Samples of the symbols that have enough bars, events and labels, and the gates of all symbols."""
    bars = labels.valued(features.select("symbol", "ts", "uid", "close"))
    events = reliable(labels.cusum_events(bars, labels.cusum_threshold(bars)))
    marked = reliable(labels.triple_barrier_labels(bars, events.select("symbol", F.col("ts").alias("t0")), recipe.days))
    gates = reliable(quality.sample_size_gates(bars, events, marked))
    names = usable_features(features)
    rows = labels.features_at_events(marked.select("symbol", "t0", "t1", "bin"), features.select("symbol", "ts", *names))
    return reliable(rows.join(small_side(gates.where("success").select("symbol")), "symbol", "left_semi")), gates


def training_samples(features: DataFrame, recipe: Recipe = Recipe()) -> DataFrame:
    """Events sampled from the cleaned bars, labelled, with their feature row."""
    return gated_samples(features, recipe)[0]


def train(features: DataFrame, recipe: Recipe = Recipe()) -> Trained:
    """Both models from the rows before the test slice.

    The slice is cut before labelling, so no label looks into the rows that are traded. Symbols with too few bars or events are
    left out; where none is left nothing is fitted, and no signal follows.
    """
    past = cv.time_split(features, order=["ts", "uid"], test=recipe.test).filter("not is_test").drop("is_test")
    samples, gates = gated_samples(past, recipe)
    names = usable_features(features)
    folds = fit_folds(samples, names, [recipe.settings], whole=True)
    meta = fit_meta(samples, reliable(folds.tested()), names) if folds.models else None
    return Trained(names, folds.whole, meta, samples.count(), gates)


def scored_slice(features: DataFrame, trained: Trained, recipe: Recipe = Recipe()) -> DataFrame:
    """Signals of the test slice with volatility recomputed inside it."""
    test = cv.time_split(features, order=["ts", "uid"], test=recipe.test).filter("is_test").drop("is_test")
    enough = test.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_TEST_ROWS)
    kept = test.join(enough.select("symbol"), "symbol", "left_semi")
    signals = score_signals(kept, trained.primary, trained.meta)
    return with_volatility(signals.select("symbol", "ts", "uid", "close", "signal", "conf"))


def backtest(
    features: DataFrame, trained: Trained, recipe: Recipe = Recipe(), thresholds: Sequence[float] = ledger.THRESHOLDS
) -> DataFrame:
    """Metrics per symbol and threshold on the test slice, with the hold return beside them."""
    book = reliable(scored_slice(features, trained, recipe))
    metrics = ledger.trade_metrics(ledger.trade_ledger(book, thresholds))
    return metrics.join(ledger.buy_and_hold(book), "symbol")
