"""Queries over bars: features, events, labels, folds, ledger, portfolio, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import trading
from tickloom.operators import cv, features, labels, ledger, portfolio, quality, scoring
from tickloom.plans import sql
from tickloom.plans.registry import query
from tickloom.sources import tables

KEYS, ORDER = tables.TICK_KEY, tables.TICK_ORDER


def r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.bars_walk(spark, sf_dir).select("symbol", "ts", "uid", "close", "volume")


def rounded(digits: int, *names: str) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


# --- window features ------------------------------------------------------------------------


@query("log_return", sql.ask(sql.RETURNS, f"SELECT symbol, uid, {rounded(10, 'log_ret')} FROM rets"))
def log_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.windowed(bars(spark, sf_dir), features.add_returns, 1).select("symbol", "uid", r("log_ret", 10))


@query(
    "pct_change", sql.ask(sql.RETURNS, "SELECT symbol, uid, round(pct, 10) AS pct_change FROM rets")
)
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.windowed(bars(spark, sf_dir), features.add_returns, 1).select("symbol", "uid", r("pct_change", 10))


FEATURE_CTES = sql.RETURNS + sql.WINDOW_FEATURES


@query("bar_tick_rule", sql.ask(FEATURE_CTES, "SELECT symbol, uid, tick_rule FROM wf"))
def bar_tick_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.windowed(bars(spark, sf_dir), features.add_tick_rule, 1).select("symbol", "uid", "tick_rule")


@query("cumulative_imbalance", sql.ask(FEATURE_CTES, "SELECT symbol, uid, imbalance, cumulative_imbalance FROM wf"))
def cumulative_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = features.windowed(bars(spark, sf_dir), features.add_imbalance, features.IMBALANCE_WINDOW)
    return added.select("symbol", "uid", "imbalance", "cumulative_imbalance")


@query(
    "trend_strength",
    sql.ask(FEATURE_CTES, f"SELECT symbol, uid, {rounded(6, 'ma_fast', 'ma_slow', 'trend_strength')} FROM wf"),
)
def trend_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = features.windowed(bars(spark, sf_dir), features.add_trend, features.SLOW_WINDOW)
    return added.select("symbol", "uid", r("ma_fast"), r("ma_slow"), r("trend_strength"))


@query("bollinger", sql.ask(FEATURE_CTES, f"SELECT symbol, uid, {rounded(6, 'bb_width', 'bb_position')} FROM wf"))
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = features.windowed(bars(spark, sf_dir), features.add_bollinger, features.BOLLINGER_WINDOW)
    return added.select("symbol", "uid", r("bb_width"), r("bb_position"))


@query(
    "regime",
    sql.ask(
        sql.WALK
        + """,
moves AS (SELECT symbol, uid, pos, CAST(cents AS DOUBLE) AS c,
  CAST(cents AS DOUBLE) / lag(CAST(cents AS DOUBLE)) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS pct FROM walk),
vols AS (SELECT *, CASE WHEN count(pct) OVER w50 >= 50 THEN stddev_samp(pct) OVER w50 END AS vol,
  CASE WHEN pos >= 25 THEN avg(c) OVER w25 END AS fast, CASE WHEN pos >= 50 THEN avg(c) OVER w50 END AS slow
  FROM moves WINDOW w25 AS (PARTITION BY symbol ORDER BY pos ROWS 24 PRECEDING),
                    w50 AS (PARTITION BY symbol ORDER BY pos ROWS 49 PRECEDING)),
avgs AS (SELECT *, CASE WHEN count(vol) OVER w100 >= 100 THEN avg(vol) OVER w100 END AS avg_vol
  FROM vols WINDOW w100 AS (PARTITION BY symbol ORDER BY pos ROWS 99 PRECEDING))""",
        """SELECT symbol, uid, CASE WHEN vol > avg_vol OR fast < slow THEN -1 WHEN vol < avg_vol AND fast > slow THEN 1
        ELSE 0 END AS regime FROM avgs""",
    ),
)
def regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On whole cents, so that equal averages compare as equal."""
    whole = tables.ticks_walk(spark, sf_dir).select("symbol", "ts", "uid", F.col("cents").cast("double").alias("close"))
    return features.windowed(whole, features.add_regime, 3 * features.REGIME_WINDOW).select("symbol", "uid", "regime")


# --- recursive and long-memory features -----------------------------------------------------


@query(
    "ewm_std",
    sql.ask(
        sql.RETURNS + sql.ewm("e50", "rets", "log_ret", 50),
        "SELECT r.symbol, r.uid, round(e.vol, 10) AS ewma_vol FROM rets r LEFT JOIN e50 e USING (symbol, pos)",
    ),
)
def ewm_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = features.windowed(bars(spark, sf_dir), features.add_returns, 1)
    return features.with_ewm_std(returns, "log_ret", features.RETURN_SPAN, "ewma_vol").select(
        "symbol", "uid", r("ewma_vol", 10)
    )


@query("rsi", sql.ask(sql.RSI, "SELECT w.symbol, w.uid, round(r.rsi, 6) AS rsi FROM walk w JOIN rsi r USING (symbol, pos)"))
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_rsi(bars(spark, sf_dir)).select("symbol", "uid", r("rsi"))


@query(
    "frac_diff",
    sql.ask(
        sql.WALK + sql.frac(features.FRACTIONAL_DEGREE, features.FRACTIONAL_CUTOFF),
        "SELECT w.symbol, w.uid, round(f.frac_close, 6) AS frac_close FROM walk w LEFT JOIN fracs f USING (symbol, pos)",
    ),
)
def frac_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_fractional_difference(bars(spark, sf_dir)).select("symbol", "uid", r("frac_close"))


@query(
    "rolling_entropy",
    sql.ask(
        sql.WALK + sql.ENTROPY,
        "SELECT w.symbol, w.uid, round(e.entropy, 6) AS entropy FROM walk w LEFT JOIN entropies e USING (symbol, pos)",
    ),
)
def rolling_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_entropy(bars(spark, sf_dir)).select("symbol", "uid", r("entropy"))


def all_features(cutoff: float) -> str:
    return (
        sql.RSI
        + sql.WINDOW_FEATURES
        + sql.ewm("e50", "rets", "log_ret", 50)
        + sql.frac(features.FRACTIONAL_DEGREE, cutoff)
        + sql.ENTROPY
        + """,
allf AS MATERIALIZED (
  SELECT w.symbol, w.ts, w.uid, w.pos, w.log_ret, e.vol AS ewma_vol, s.rsi, w.bb_width, w.bb_position, f.frac_close,
         h.entropy, w.tick_rule, w.imbalance, w.cumulative_imbalance, w.ma_fast, w.ma_slow, w.trend_strength
  FROM wf w LEFT JOIN e50 e USING (symbol, pos) LEFT JOIN rsi s USING (symbol, pos)
  LEFT JOIN fracs f USING (symbol, pos) LEFT JOIN entropies h USING (symbol, pos))"""
    )


ALL_FEATURES = all_features(features.FRACTIONAL_CUTOFF)
PLAIN = ["imbalance", "cumulative_imbalance", "tick_rule"]
ROUNDED = [c for c in features.FEATURES if c not in PLAIN]
FEATURES_OUT = f"SELECT symbol, uid, {', '.join(PLAIN)}, {rounded(6, *ROUNDED)} FROM allf"


def _features_out(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select("symbol", "uid", *(c for c in PLAIN if c in have), *(r(c) for c in ROUNDED if c in have))


@query("generate_features", sql.ask(ALL_FEATURES, FEATURES_OUT))
def generate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features_out(features.generate_features(bars(spark, sf_dir)))


@query(
    "clean_features",
    sql.ask(ALL_FEATURES, FEATURES_OUT + " WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in features.FEATURES)),
)
def clean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features_out(features.clean_features(features.generate_features(bars(spark, sf_dir))))


@query(
    "feature_columns",
    sql.ask(
        ALL_FEATURES,
        " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS known FROM allf" for c in features.FEATURES),
    ),
)
def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature column with the number of rows that have it."""
    made = features.generate_features(bars(spark, sf_dir))
    names = features.feature_columns(made)
    counts = made.agg(*(F.count(c).alias(c) for c in names))
    return counts.unpivot([], names, "feature", "known")


WHOLE_ROWS = " AND ".join(f"{c} IS NOT NULL" for c in features.FEATURES)


@query(
    "bars_for_features",
    sql.ask(
        ALL_FEATURES,
        f"SELECT w.symbol, w.uid, w.close FROM walk w SEMI JOIN (SELECT * FROM allf WHERE {WHOLE_ROWS}) f USING (symbol, pos)",
    ),
)
def bars_for_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose features survive cleaning."""
    frame = bars(spark, sf_dir)
    usable = features.clean_features(features.generate_features(frame))
    keys = ["symbol", "ts", "uid"]
    return frame.join(usable.select(*keys), keys, "left_semi").select("symbol", "uid", "close")


# --- splits ---------------------------------------------------------------------------------


@query("time_split", sql.ask(sql.WALK, "SELECT symbol, uid, pos > floor(n * 0.8::DOUBLE) AS is_test FROM walk"))
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.time_split(bars(spark, sf_dir), order=ORDER).select("symbol", "uid", "is_test")


@query(
    "cv_fold_id",
    sql.ask(sql.WALK, "SELECT symbol, uid, CAST(ntile(5) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS INTEGER) AS fold FROM walk"),
)
def cv_fold_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.cv_fold_id(bars(spark, sf_dir), order=ORDER).select("symbol", "uid", "fold")


# --- events and labels ----------------------------------------------------------------------


@query("cusum_threshold", sql.ask(sql.THRESH, "SELECT symbol, round(h, 8) AS threshold FROM cthresh"))
def cusum_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.cusum_threshold(bars(spark, sf_dir)).select("symbol", r("threshold", 8))


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.valued(bars(spark, sf_dir))


def _events(frame: DataFrame) -> DataFrame:
    return labels.cusum_events(frame, labels.cusum_threshold(frame))


def _event_times(frame: DataFrame) -> DataFrame:
    return _events(frame).select("symbol", F.col("ts").alias("t0"))


def _labels(frame: DataFrame) -> DataFrame:
    return labels.triple_barrier_labels(frame, _events(frame).select("symbol", F.col("ts").alias("t0"), "uid"))


@query("cusum_events", sql.ask(sql.CUSUM, "SELECT symbol, ts, uid, side FROM cevents"))
def cusum_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(_valued(spark, sf_dir))


@query(
    "cusum_events_default",
    sql.ask(
        sql.CUSUM.replace(
            "SELECT symbol, 2.0::DOUBLE * avg(vol) AS h FROM v100 GROUP BY symbol",
            "SELECT symbol, stddev_samp(pct) AS h FROM rets GROUP BY symbol",
        ),
        "SELECT symbol, ts, uid, side FROM cevents",
    ),
)
def cusum_events_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = bars(spark, sf_dir)
    return labels.cusum_events(frame, labels.return_deviation(frame))


@query(
    "cusum_events_log",
    sql.ask(
        sql.CUSUM.replace("c.up + r.delta", "c.up + r.log_ret").replace("c.down + r.delta", "c.down + r.log_ret"),
        "SELECT symbol, ts, uid, side FROM cevents",
    ),
)
def cusum_events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log returns against the threshold on their own scale, so that moves add up before they cross it."""
    frame = _valued(spark, sf_dir)
    return labels.cusum_events(frame, labels.cusum_threshold(frame), delta="log")


@query("vertical_barrier", sql.ask(sql.VERTICAL, "SELECT symbol, t0, v1 AS t1 FROM vert"))
def vertical_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _valued(spark, sf_dir)
    return labels.vertical_barrier(frame, _event_times(frame)).select("symbol", "t0", "t1")


@query(
    "triple_barrier_labels",
    sql.ask(
        sql.LABELS,
        """SELECT symbol, t0, t1, sl_ts AS stop_loss_ts, pt_ts AS profit_taking_ts, round(ret, 8) AS ret, bin,
        round(p0 * (1 + vol * 2), 6) AS profit_taking_price, round(p0 * (1 - vol * 2), 6) AS stop_loss_price
        FROM labelled""",
    ),
)
def triple_barrier_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(_valued(spark, sf_dir)).withColumns(
        {
            "ret": F.round("ret", 8),
            "profit_taking_price": F.round("profit_taking_price", 6),
            "stop_loss_price": F.round("stop_loss_price", 6),
        }
    )


# Every bar an event: the widest use of the interval search.
DENSE = (
    sql.VOL
    + """,
vert AS MATERIALIZED (
  SELECT symbol, ts AS t0, pos, close AS p0,
         min(ts) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 5 DAY FOLLOWING AND UNBOUNDED FOLLOWING) AS v1
  FROM walk),
ready AS (SELECT e.*, v.vol FROM vert e JOIN v100 v USING (symbol, pos) WHERE v.vol IS NOT NULL AND v1 IS NOT NULL),
touch AS (
  SELECT e.symbol, e.t0,
         min(CASE WHEN ln(w.close / e.p0) * -1 < -8.0::DOUBLE * e.vol THEN w.ts END) AS sl_ts,
         min(CASE WHEN ln(w.close / e.p0) * -1 > 4.0::DOUBLE * e.vol THEN w.ts END) AS pt_ts
  FROM ready e JOIN walk w ON w.symbol = e.symbol AND w.ts BETWEEN e.t0 AND e.v1 GROUP BY e.symbol, e.t0)"""
)


@query("triple_barrier_touch", sql.ask(DENSE, "SELECT symbol, t0, sl_ts, pt_ts FROM touch"))
def triple_barrier_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short side, every bar an event, five days, wide barriers."""
    frame = _valued(spark, sf_dir)
    events = frame.select("symbol", F.col("ts").alias("t0"))
    start = frame.select(
        "symbol", F.col("ts").alias("t0"), F.col("close").alias("p0"), "vol", F.lit(-1.0).alias("side")
    )
    ends = labels.vertical_barrier(frame, events, days=5)
    ready = start.join(ends, ["symbol", "t0"]).filter("vol is not null")
    return labels.barrier_touches(frame, ready, pt=4.0, sl=8.0).select("symbol", "t0", "sl_ts", "pt_ts")


@query(
    "vol_at_event",
    sql.ask(sql.CUSUM, "SELECT e.symbol, e.ts AS t0, round(v.vol, 10) AS vol FROM cevents e JOIN v100 v USING (symbol, pos) WHERE v.vol IS NOT NULL"),
)
def vol_at_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _valued(spark, sf_dir)
    vol = frame.select("symbol", F.col("ts").alias("t0"), r("vol", 10))
    return _event_times(frame).join(vol, ["symbol", "t0"]).filter("vol is not null")


@query(
    "price_at_touch",
    sql.ask(sql.LABELS, "SELECT symbol, t0, t1, p0, round(p0 * (1 + ret), 6) AS p1 FROM labelled"),
)
def price_at_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _valued(spark, sf_dir)
    price = frame.select("symbol", F.col("ts").alias("t0"), F.col("close").alias("p0"))
    return _labels(frame).join(price, ["symbol", "t0"]).select(
        "symbol", "t0", "t1", "p0", F.round(F.col("p0") * (1 + F.col("ret")), 6).alias("p1")
    )


@query(
    "sample_size_gates",
    sql.ask(
        sql.LABELS,
        """SELECT *, reason IS NULL AS success FROM (
        SELECT b.symbol, b.bars, coalesce(e.events, 0) AS events, coalesce(l.labels, 0) AS labels,
          CASE WHEN b.bars < 200 THEN 'insufficient_bars_' || b.bars
               WHEN coalesce(e.events, 0) < 50 THEN 'cusum_filtered_too_aggressive'
               WHEN coalesce(l.labels, 0) = 0 THEN 'no_labels' END AS reason
        FROM (SELECT symbol, count(*) AS bars FROM walk GROUP BY 1) b
        LEFT JOIN (SELECT symbol, count(*) AS events FROM cevents GROUP BY 1) e USING (symbol)
        LEFT JOIN (SELECT symbol, count(*) AS labels FROM labelled GROUP BY 1) l USING (symbol))""",
    ),
)
def sample_size_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _valued(spark, sf_dir)
    return quality.sample_size_gates(frame, _events(frame), _labels(frame))


PURGED = (
    sql.LABELS
    + """,
placed AS MATERIALIZED (
  SELECT symbol, t0, t1, row_number() OVER w AS pos, count(*) OVER (PARTITION BY symbol) AS n,
         ntile(5) OVER w - 1 AS own FROM labelled WINDOW w AS (PARTITION BY symbol ORDER BY t0)),
edges AS MATERIALIZED (
  SELECT symbol, own AS fold, min(t0) AS test_start, max(t1) AS test_end FROM placed GROUP BY symbol, own),
bounds AS MATERIALIZED (
  SELECT e.*, (SELECT count(*) FROM placed p WHERE p.symbol = e.symbol AND p.t0 < e.test_end) AS reach FROM edges e)"""
)


@query(
    "purged_folds",
    sql.ask(
        PURGED,
        """SELECT CAST(b.fold AS INTEGER) AS fold, p.symbol, p.t0, p.t1, CASE WHEN p.own = b.fold THEN 'test'
        WHEN p.t1 <= b.test_start OR p.pos > b.reach + floor(0.01::DOUBLE * p.n) THEN 'train' ELSE 'purged' END AS role
        FROM placed p JOIN bounds b USING (symbol)""",
    ),
)
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cv.purged_folds(_labels(_valued(spark, sf_dir)))


# --- ledger ---------------------------------------------------------------------------------


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the test slice with volatility recomputed inside it."""
    test = cv.time_split(tables.signals_walk(spark, sf_dir), order=ORDER).filter("is_test")
    return labels.with_volatility(test.drop("is_test"))


@query(
    "entry_filter",
    sql.ask(sql.WALK + f", sig AS ({sql.SIGNALS_BODY})", "SELECT symbol, uid, signal, conf FROM sig WHERE signal <> 0 AND conf > 0.6::DOUBLE"),
)
def entry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = tables.signals_walk(spark, sf_dir).select("symbol", "uid", "signal", "conf")
    return signals.filter(trading.entry_allowed(F.col("signal"), F.col("conf"), 0.6))


@query(
    "trade_ledger",
    sql.ask(sql.LEDGER, f"SELECT symbol, threshold, entry_ts, exit_ts, side, {rounded(10, 'ret')}, reason, conf FROM trades"),
)
def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = ledger.trade_ledger(_book(spark, sf_dir))
    return trades.withColumn("ret", F.round("ret", 10))


METRICS = (
    sql.LEDGER
    + """,
metrics AS MATERIALIZED (
  SELECT symbol, threshold, product(1 + ret) - 1 AS cum_ret, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate,
         CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(12600.0::DOUBLE) ELSE 0.0::DOUBLE END AS sharpe,
         count(*) AS trades
  FROM trades GROUP BY symbol, threshold)"""
)


@query(
    "trade_metrics",
    sql.ask(METRICS, f"SELECT symbol, threshold, trades, {rounded(8, 'cum_ret', 'win_rate')}, {rounded(6, 'sharpe')} FROM metrics"),
)
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.trade_metrics(ledger.trade_ledger(_book(spark, sf_dir)))
    return found.select("symbol", "threshold", "trades", r("cum_ret", 8), r("win_rate", 8), r("sharpe"))


@query(
    "best_threshold",
    sql.ask(
        METRICS,
        """SELECT symbol, threshold, trades, round(cum_ret, 8) AS cum_ret FROM metrics
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY cum_ret DESC, threshold) = 1""",
    ),
)
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.best_threshold(ledger.trade_metrics(ledger.trade_ledger(_book(spark, sf_dir))))
    return found.select("symbol", "threshold", "trades", r("cum_ret", 8))


@query(
    "buy_and_hold",
    sql.ask(sql.SLICE, "SELECT symbol, round(max_by(close, pos) / min_by(close, pos) - 1, 8) AS bh_return FROM book GROUP BY symbol"),
)
def buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = cv.time_split(bars(spark, sf_dir), order=ORDER).filter("is_test")
    return ledger.buy_and_hold(test).select("symbol", r("bh_return", 8))


INTENTS = (
    sql.VOL
    + f""",
sig AS MATERIALIZED ({sql.SIGNALS_BODY}),
eligible AS MATERIALIZED (
  SELECT s.symbol, s.ts, s.close, s.signal, s.conf, v.vol, lag(signal) OVER (PARTITION BY s.symbol ORDER BY s.pos) AS before
  FROM sig s LEFT JOIN v100 v USING (symbol, pos) WHERE s.signal <> 0 AND s.conf > 0.6::DOUBLE),
acted AS (
  SELECT *, CASE WHEN signal = 1 THEN 'buy' ELSE 'sell_all' END AS action FROM eligible
  WHERE signal <> coalesce(before, -1))"""
)


INTENTS_SQL = sql.ask(
    INTENTS,
    """SELECT symbol, ts, action,
    CASE WHEN signal = 1 THEN CAST(greatest(1, floor(100000.0::DOUBLE * 0.2::DOUBLE *
      least(greatest(0.5::DOUBLE * (conf - (1 - conf)), 0), 1) / close)) AS BIGINT) END AS qty,
    CASE WHEN signal = 1 THEN round(close * (1 + vol * 2), 6) END AS take_profit,
    CASE WHEN signal = 1 THEN round(close * (1 - vol * 2), 6) END AS stop_loss FROM acted""",
)


@query("order_intents", INTENTS_SQL)
def order_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = labels.with_volatility(tables.signals_walk(spark, sf_dir))
    weights = signals.select("symbol").distinct().withColumn("weight", F.lit(0.2))
    return ledger.order_intents(signals, weights, 100_000.0).select(
        "symbol", "ts", "action", "qty", r("take_profit"), r("stop_loss")
    )


# --- portfolio ------------------------------------------------------------------------------


@query("aligned_returns", sql.ask(sql.ALIGNED, "SELECT symbol, CAST(date AS VARCHAR) AS date, round(ret, 10) AS ret FROM aligned"))
def aligned_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = portfolio.aligned_returns(tables.daily_close(spark, sf_dir))
    return returns.select("symbol", F.col("date").cast("string").alias("date"), r("ret", 10))


@query(
    "pairwise_covariance",
    sql.ask(sql.ALIGNED, "SELECT x.symbol AS a, y.symbol AS b, round(covar_samp(x.ret, y.ret), 10) AS cov FROM aligned x JOIN aligned y USING (date) GROUP BY ALL"),
)
def pairwise_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = portfolio.aligned_returns(tables.daily_close(spark, sf_dir))
    return portfolio.pairwise_covariance(returns).select("a", "b", r("cov", 10))


@query(
    "inverse_variance_weights",
    sql.ask(
        sql.ALIGNED + ", inv AS (SELECT symbol, 1.0::DOUBLE / nullif(var_samp(ret), 0) AS inv FROM aligned GROUP BY symbol)",
        "SELECT symbol, round(CASE WHEN sum(inv) OVER () IS NULL THEN 1.0::DOUBLE / count(*) OVER () ELSE coalesce(inv / sum(inv) OVER (), 0) END, 8) AS weight FROM inv",
    ),
)
def inverse_variance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = portfolio.aligned_returns(tables.daily_close(spark, sf_dir))
    return portfolio.inverse_variance_weights(returns).select("symbol", r("weight", 8))


def _rebalance_sql(days: int) -> str:
    return sql.ask(
        sql.DAILY
        + f""", dates AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM daily)),
        own AS (SELECT symbol, k, close, coalesce(lag(k, {days - 1}) OVER w, first_value(k) OVER w) AS st
                FROM daily JOIN dates USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY k)),
        cells AS (SELECT s.symbol, d.k, d.date FROM (SELECT DISTINCT symbol FROM daily) s, dates d),
        filled AS (SELECT c.symbol, c.k, c.date, last_value(close IGNORE NULLS) OVER w AS close, last_value(st IGNORE NULLS) OVER w AS st
                   FROM cells c LEFT JOIN own o ON o.symbol = c.symbol AND o.k = c.k
                   WINDOW w AS (PARTITION BY c.symbol ORDER BY c.k ROWS UNBOUNDED PRECEDING)),
        grid AS MATERIALIZED (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY k) - 1 AS ret FROM filled WHERE close IS NOT NULL),
        frames AS (SELECT k, max(st) AS m FROM grid GROUP BY k HAVING count(ret) > 0),
        inv AS (SELECT g.symbol, g.date, 1.0::DOUBLE / nullif(var_samp(h.ret), 0) AS inv
                FROM frames f JOIN grid g ON g.k = f.k
                LEFT JOIN grid h ON h.symbol = g.symbol AND h.k > f.m AND h.k <= f.k GROUP BY g.symbol, g.date)""",
        """SELECT CAST(date AS VARCHAR) AS as_of, symbol, round(CASE WHEN sum(inv) OVER (PARTITION BY date) IS NULL
        THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY date)
        ELSE coalesce(inv / sum(inv) OVER (PARTITION BY date), 0) END, 8) AS weight FROM inv""",
    )


def _rebalanced(spark: SparkSession, sf_dir: str, days: int) -> DataFrame:
    weights = portfolio.rebalance_weights(tables.daily_close(spark, sf_dir), days)
    return weights.select(F.col("as_of").cast("string").alias("as_of"), "symbol", r("weight", 8))


@query("rebalance_weights", _rebalance_sql(portfolio.LOOKBACK_DAYS))
def rebalance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rebalanced(spark, sf_dir, portfolio.LOOKBACK_DAYS)


@query("rebalance_weights_short", _rebalance_sql(10))
def rebalance_weights_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten closes, nine returns, so that the trailing frame moves within the month."""
    return _rebalanced(spark, sf_dir, 10)


# --- scalar rules and scores ----------------------------------------------------------------

SIG = sql.WALK + f", sig AS MATERIALIZED ({sql.SIGNALS_BODY})"


@query(
    "trade_cost",
    """SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice * 0.0001::DOUBLE + CASE WHEN l_returnflag = 'R' THEN
       l_extendedprice * (8.0::DOUBLE / 1000000) + least(l_quantity * 0.000166::DOUBLE, 8.30::DOUBLE) ELSE 0 END, 6) AS cost FROM lineitem""",
)
def trade_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.read_table(spark, sf_dir, "lineitem")
    side = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    cost = trading.trade_cost(price, F.col("l_quantity"), side)
    return items.select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(cost, 6).alias("cost"))


@query(
    "kelly_fraction",
    sql.ask(SIG, """SELECT symbol, uid, round(CASE WHEN conf <= 0.5::DOUBLE THEN 0 ELSE
        greatest(0, least(0.5::DOUBLE * (conf - (1 - conf)), 1)) END, 10) AS kelly FROM sig"""),
)
def kelly_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.signals_walk(spark, sf_dir).select(
        "symbol", "uid", F.round(trading.kelly_fraction(F.col("conf")), 10).alias("kelly")
    )


@query("bet_size", sql.ask(SIG, "SELECT symbol, uid, CASE WHEN conf < 0.5::DOUBLE THEN 0.0::DOUBLE ELSE conf END AS bet FROM sig"))
def bet_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.signals_walk(spark, sf_dir).select("symbol", "uid", trading.bet_size(F.col("conf")).alias("bet"))


@query(
    "barrier_prices",
    sql.ask(SIG, """SELECT symbol, uid, round(close * (1 + CASE WHEN signal < 0 THEN -1 ELSE 1 END * 0.01::DOUBLE * 2), 6) AS tp,
        round(close * (1 - CASE WHEN signal < 0 THEN -1 ELSE 1 END * 0.01::DOUBLE * 2), 6) AS sl FROM sig"""),
)
def barrier_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    take, stop = trading.barrier_prices(F.col("close"), F.lit(0.01), F.col("signal"), 2.0, 2.0)
    signals = tables.signals_walk(spark, sf_dir)
    return signals.select("symbol", "uid", F.round(take, 6).alias("tp"), F.round(stop, 6).alias("sl"))


@query(
    "order_qty",
    sql.ask(SIG, """SELECT symbol, uid, CAST(greatest(1, floor(50000.0::DOUBLE * 0.1::DOUBLE * conf / close)) AS BIGINT) AS qty FROM sig"""),
)
def order_qty(spark: SparkSession, sf_dir: str) -> DataFrame:
    qty = trading.order_qty(F.lit(50_000.0), F.lit(0.1), F.col("conf"), F.col("close"))
    return tables.signals_walk(spark, sf_dir).select("symbol", "uid", qty.alias("qty"))


@query("label_bin", sql.ask(sql.RETURNS, "SELECT symbol, uid, CAST(sign(pct) AS INTEGER) AS bin FROM rets"))
def label_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = features.windowed(bars(spark, sf_dir), features.add_returns, 1)
    return returns.select("symbol", "uid", trading.label_bin(F.col("pct_change")).alias("bin"))


JUDGED = sql.LABELS + f", sig AS ({sql.SIGNALS_BODY}), judged AS (SELECT l.symbol, l.t0, l.bin, s.signal FROM labelled l JOIN sig s ON s.symbol = l.symbol AND s.ts = l.t0)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = tables.signals_walk(spark, sf_dir).select("symbol", F.col("ts").alias("t0"), "signal")
    return _labels(_valued(spark, sf_dir)).select("symbol", "t0", "bin").join(signals, ["symbol", "t0"])


@query("meta_label", sql.ask(JUDGED, "SELECT symbol, t0, CAST(signal = bin AS INTEGER) AS hit FROM judged"))
def meta_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir)
    return judged.select("symbol", "t0", trading.meta_label(F.col("signal"), F.col("bin")).alias("hit"))


@query(
    "class_balance",
    sql.ask(JUDGED, """SELECT bin, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 8) AS weight
        FROM judged GROUP BY bin"""),
)
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.class_balance(_judged(spark, sf_dir), "bin").select("bin", r("weight", 8))


@query(
    "weighted_f1",
    sql.ask(
        JUDGED
        + """, classes AS (SELECT c.bin, (SELECT count(*) FROM judged j WHERE j.bin = c.bin) AS t,
          (SELECT count(*) FROM judged j WHERE j.signal = c.bin) AS p,
          (SELECT count(*) FROM judged j WHERE j.bin = c.bin AND j.signal = c.bin) AS h FROM (SELECT DISTINCT bin FROM judged) c)""",
        "SELECT round(sum(t * 2.0::DOUBLE * h / (t + p)) / sum(t), 8) AS f1 FROM classes",
    ),
)
def weighted_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.weighted_f1(_judged(spark, sf_dir), "bin", "signal").select(r("f1", 8))


@query(
    "latest_per_symbol",
    sql.ask(FEATURE_CTES, f"SELECT symbol, uid, {rounded(6, 'close', 'trend_strength')} FROM wf QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY pos DESC) = 1"),
)
def latest_per_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = features.windowed(bars(spark, sf_dir), features.add_trend, features.SLOW_WINDOW)
    return scoring.latest_per_symbol(made).select("symbol", "uid", r("close"), r("trend_strength"))


@query(
    "argmax_class",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class FROM embeddings""",
)
def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coordinate stands in for a class score."""
    vectors = tables.read_table(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", scoring.argmax_class(F.col("embedding")).alias("class"))


@query(
    "math",
    """SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 8) AS log_price, round(sqrt(l_quantity), 8) AS root_qty,
       CAST(sign(l_discount - 0.05::DOUBLE) AS INTEGER) AS lean, round(abs(l_discount - l_tax), 8) AS gap,
       least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high FROM lineitem""",
)
def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = tables.read_table(spark, sf_dir, "lineitem")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.ln("l_extendedprice"), 8).alias("log_price"),
        F.round(F.sqrt("l_quantity"), 8).alias("root_qty"),
        F.signum(F.col("l_discount") - 0.05).cast("int").alias("lean"),
        F.round(F.abs(F.col("l_discount") - F.col("l_tax")), 8).alias("gap"),
        F.least("l_discount", "l_tax").alias("low"),
        F.greatest("l_discount", "l_tax").alias("high"),
    )
