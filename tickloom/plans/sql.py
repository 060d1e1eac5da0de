"""Building blocks of the checking SQL: common table expressions over the test tables."""

from __future__ import annotations

from tickloom.sources.tables import HISTORY_SPAN

TICKS = """
ticks AS MATERIALIZED (
  SELECT event_type AS symbol, ts, event_id AS uid, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value
  FROM events)"""

WALK = (
    TICKS
    + """,
walk AS MATERIALIZED (
  SELECT symbol, ts, uid, k,
         CAST(100000 + sum(2 * k - 99) OVER w AS DOUBLE) / 100.0::DOUBLE AS close,
         CAST(100000 + sum(2 * k - 99) OVER w AS BIGINT) AS cents,
         CAST(floor(value) + 1 AS DOUBLE) AS volume,
         row_number() OVER w AS pos,
         count(*) OVER (PARTITION BY symbol) AS n
  FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, uid))"""
)

# Order lines as years of bars; the columns of ``walk`` that features and labels read.
LONG_WALK = f"""
lines AS (
  SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS day, 2 * (l_partkey % 100) - 99 AS step, l_quantity AS volume,
         row_number() OVER (PARTITION BY l_returnflag || l_linestatus, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber) AS uid
  FROM lineitem),
moves AS (
  SELECT symbol, uid, volume, CAST(day AS TIMESTAMP) + (uid - 1) * INTERVAL 1 MILLISECOND AS ts,
         CAST(sum(step) OVER (PARTITION BY symbol ORDER BY day, uid) AS BIGINT) + {HISTORY_SPAN} AS moved FROM lines),
walk AS MATERIALIZED (
  SELECT symbol, ts, uid, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts, uid) AS pos, count(*) OVER (PARTITION BY symbol) AS n,
         ({HISTORY_SPAN} + abs(((moved % {4 * HISTORY_SPAN}) + {4 * HISTORY_SPAN}) % {4 * HISTORY_SPAN} - {2 * HISTORY_SPAN})) / 100.0::DOUBLE AS close
  FROM moves)"""


def on_history(ctes: str) -> str:
    """Expressions that start with ``WALK``, over the long history instead."""
    return LONG_WALK + ctes.removeprefix(WALK)


RETURNS = (
    WALK
    + """,
rets AS MATERIALIZED (
  SELECT *, ln(close / lag(close) OVER w) AS log_ret, close / lag(close) OVER w - 1 AS pct,
         close - lag(close) OVER w AS delta, lag(close) OVER w AS prev
  FROM walk WINDOW w AS (PARTITION BY symbol ORDER BY pos))"""
)


def ewm(name: str, source: str, value: str, span: int) -> str:
    """Bias-corrected exponential deviation of ``value``; the value is null at pos 1 only."""
    decay = f"(1 - 2.0::DOUBLE / {span + 1})"
    return f""",
{name}_sums AS (
  SELECT symbol, pos, 1.0::DOUBLE AS w, {value} AS wx, {value} * {value} AS wxx, 1.0::DOUBLE AS w2
  FROM {source} WHERE pos = 2
  UNION ALL
  SELECT s.symbol, s.pos, 1 + {decay} * p.w, s.{value} + {decay} * p.wx,
         s.{value} * s.{value} + {decay} * p.wxx, 1 + {decay} * {decay} * p.w2
  FROM {name}_sums p JOIN {source} s ON s.symbol = p.symbol AND s.pos = p.pos + 1),
{name} AS MATERIALIZED (
  SELECT symbol, pos, CASE WHEN pos > 2 THEN
    sqrt(greatest((wxx / w - (wx / w) * (wx / w)) * (w * w) / (w * w - w2), 0)) END AS vol
  FROM {name}_sums)"""


VOL = RETURNS + ewm("v100", "rets", "pct", 100)

THRESH = (
    VOL
    + """,
cthresh AS MATERIALIZED (SELECT symbol, 2.0::DOUBLE * avg(vol) AS h FROM v100 GROUP BY symbol)"""
)

CUSUM = (
    THRESH
    + """,
cs AS (
  SELECT r.symbol, r.pos, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS side FROM rets r WHERE pos = 1
  UNION ALL
  SELECT symbol, pos,
         CASE WHEN NOT (d < -h) AND u > h THEN 0.0::DOUBLE ELSE u END,
         CASE WHEN d < -h THEN 0.0::DOUBLE ELSE d END,
         CASE WHEN d < -h THEN -1 WHEN u > h THEN 1 ELSE 0 END
  FROM (SELECT r.symbol, r.pos, t.h, greatest(0.0::DOUBLE, c.up + r.delta) AS u,
               least(0.0::DOUBLE, c.down + r.delta) AS d
        FROM cs c JOIN rets r ON r.symbol = c.symbol AND r.pos = c.pos + 1
        JOIN cthresh t ON t.symbol = r.symbol)),
cevents AS MATERIALIZED (
  SELECT w.symbol, w.ts, w.uid, w.pos, w.close, c.side
  FROM cs c JOIN walk w ON w.symbol = c.symbol AND w.pos = c.pos WHERE c.side <> 0)"""
)

VERTICAL = (
    CUSUM
    + """,
vert AS MATERIALIZED (
  SELECT e.symbol, e.ts AS t0, e.pos, e.close AS p0, min(w.ts) AS v1
  FROM cevents e JOIN walk w ON w.symbol = e.symbol AND w.ts >= e.ts + INTERVAL 20 DAY
  GROUP BY e.symbol, e.ts, e.pos, e.close)"""
)

LABELS = (
    VERTICAL
    + """,
ready AS (
  SELECT e.*, v.vol FROM vert e JOIN v100 v ON v.symbol = e.symbol AND v.pos = e.pos WHERE v.vol IS NOT NULL),
touch AS MATERIALIZED (
  SELECT e.symbol, e.t0, e.p0, e.vol, e.v1,
         min(CASE WHEN ln(w.close / e.p0) < -2.0::DOUBLE * e.vol THEN w.ts END) AS sl_ts,
         min(CASE WHEN ln(w.close / e.p0) > 2.0::DOUBLE * e.vol THEN w.ts END) AS pt_ts
  FROM ready e JOIN walk w ON w.symbol = e.symbol AND w.ts BETWEEN e.t0 AND e.v1
  GROUP BY e.symbol, e.t0, e.p0, e.vol, e.v1),
labelled AS MATERIALIZED (
  SELECT t.symbol, t.t0, w.ts AS t1, t.sl_ts, t.pt_ts, t.p0, t.vol, w.close / t.p0 - 1 AS ret,
         CAST(sign(w.close / t.p0 - 1) AS INTEGER) AS bin
  FROM touch t JOIN walk w ON w.symbol = t.symbol
   AND w.ts = least(t.v1, coalesce(t.sl_ts, t.v1), coalesce(t.pt_ts, t.v1)))"""
)

SIGNALS_BODY = """
  SELECT symbol, ts, uid, k, close, pos, n,
         CASE WHEN count(*) OVER w20 >= 20 THEN CAST(sign(20 * cents - sum(cents) OVER w20) AS INTEGER) ELSE 0 END AS signal,
         (90 + k) / 200.0::DOUBLE AS conf
  FROM walk WINDOW w20 AS (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING)"""

# Test slice of the walk with volatility recomputed inside it.
SLICE = (
    WALK
    + f""",
sig AS MATERIALIZED ({SIGNALS_BODY}),
cutoff AS MATERIALIZED (
  SELECT symbol, ts, close, signal, conf, row_number() OVER (PARTITION BY symbol ORDER BY pos) AS pos
  FROM sig WHERE pos > floor(n * 0.8::DOUBLE)),
rets AS MATERIALIZED (
  SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY pos) - 1 AS pct FROM cutoff)"""
    + ewm("v100", "rets", "pct", 100)
    + """,
book AS MATERIALIZED (
  SELECT c.symbol, c.ts, c.close, c.signal, c.conf, c.pos, v.vol
  FROM cutoff c LEFT JOIN v100 v ON v.symbol = c.symbol AND v.pos = c.pos)"""
)

# Ledger: one row per (symbol, threshold, bar) with the trade open after that bar.
LEDGER = (
    SLICE
    + """,
grid AS (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7])::DOUBLE AS threshold),
walked AS (
  SELECT b.symbol, g.threshold, 0::BIGINT AS pos, -1 AS held, 0 AS side, 0.0::DOUBLE AS entry,
         NULL::DOUBLE AS tp, NULL::DOUBLE AS sl, 0.0::DOUBLE AS conf, NULL::TIMESTAMP AS since,
         NULL::TIMESTAMP AS closed, NULL::DOUBLE AS exit_price, NULL::VARCHAR AS reason
  FROM (SELECT DISTINCT symbol FROM book) b, grid g
  UNION ALL
  SELECT symbol, threshold, pos,
         CASE WHEN reason IS NOT NULL THEN -1 WHEN was >= 0 THEN was + 1 WHEN enters THEN 0 ELSE -1 END,
         CASE WHEN was >= 0 THEN side ELSE signal END,
         CASE WHEN was >= 0 THEN entry ELSE close END,
         CASE WHEN was >= 0 THEN tp ELSE close * (1 + signal * vol * 2.0::DOUBLE) END,
         CASE WHEN was >= 0 THEN sl ELSE close * (1 - signal * vol * 2.0::DOUBLE) END,
         CASE WHEN was >= 0 THEN conf ELSE now_conf END,
         CASE WHEN was >= 0 THEN since ELSE ts END,
         CASE WHEN reason IS NOT NULL THEN ts END,
         CASE reason WHEN 'TP' THEN tp WHEN 'SL' THEN sl WHEN 'TIME' THEN close END,
         reason
  FROM (
    SELECT p.symbol, p.threshold, b.pos, b.ts, b.close, b.vol, b.signal, b.conf AS now_conf, p.held AS was,
           p.side, p.entry, p.tp, p.sl, p.conf, p.since,
           b.signal <> 0 AND b.conf > p.threshold AS enters,
           CASE WHEN p.held < 0 THEN NULL
                WHEN (p.side > 0 AND b.close >= p.tp) OR (p.side < 0 AND b.close <= p.tp) THEN 'TP'
                WHEN (p.side > 0 AND b.close <= p.sl) OR (p.side < 0 AND b.close >= p.sl) THEN 'SL'
                WHEN p.held + 1 >= 20 THEN 'TIME' END AS reason
    FROM walked p JOIN book b ON b.symbol = p.symbol AND b.pos = p.pos + 1)),
priced AS (
  SELECT *, entry * 100 * 0.0001::DOUBLE + CASE WHEN side < 0 THEN
              entry * 100 * (8.0::DOUBLE / 1000000) + least(100 * 0.000166::DOUBLE, 8.30::DOUBLE) ELSE 0 END AS cost_in,
         exit_price * 100 * 0.0001::DOUBLE + CASE WHEN side > 0 THEN
              exit_price * 100 * (8.0::DOUBLE / 1000000) + least(100 * 0.000166::DOUBLE, 8.30::DOUBLE) ELSE 0 END AS cost_out
  FROM walked WHERE reason IS NOT NULL),
trades AS MATERIALIZED (
  SELECT symbol, threshold, since AS entry_ts, closed AS exit_ts, side,
         ((exit_price - entry) * 100 * side - cost_in - cost_out) / (entry * 100) AS ret, reason, conf
  FROM priced)"""
)

RSI = (
    RETURNS
    + """,
gains AS MATERIALIZED (
  SELECT symbol, pos, CASE WHEN delta > 0 THEN delta ELSE 0.0::DOUBLE END AS up,
         CASE WHEN delta < 0 THEN -delta ELSE 0.0::DOUBLE END AS down FROM rets),
wilder AS (
  SELECT symbol, pos, up, down FROM gains WHERE pos = 1
  UNION ALL
  SELECT g.symbol, g.pos, g.up * (1.0::DOUBLE / 14) + p.up * (1 - 1.0::DOUBLE / 14),
         g.down * (1.0::DOUBLE / 14) + p.down * (1 - 1.0::DOUBLE / 14)
  FROM wilder p JOIN gains g ON g.symbol = p.symbol AND g.pos = p.pos + 1),
rsi AS MATERIALIZED (
  SELECT symbol, pos, CASE WHEN pos < 14 THEN NULL WHEN down = 0 THEN 100.0::DOUBLE
                           ELSE 100 - 100 / (1 + up / down) END AS rsi FROM wilder)"""
)


def frac(degree: float, cutoff: float) -> str:
    """Fixed-width fractional difference of the walk; the weights come from a recursion."""
    return f""",
weights AS (
  SELECT 0 AS lag, 1.0::DOUBLE AS w
  UNION ALL
  SELECT lag + 1, -w * ({degree}::DOUBLE - lag) / (lag + 1) FROM weights
  WHERE abs(-w * ({degree}::DOUBLE - lag) / (lag + 1)) >= {cutoff}::DOUBLE),
width AS (SELECT count(*) AS m FROM weights),
fracs AS MATERIALIZED (
  SELECT w.symbol, w.pos, sum(p.close * g.w) AS frac_close
  FROM walk w JOIN width d ON w.pos >= d.m
  JOIN walk p ON p.symbol = w.symbol AND p.pos <= w.pos AND p.pos > w.pos - d.m
  JOIN weights g ON g.lag = w.pos - p.pos
  GROUP BY w.symbol, w.pos)"""


ENTROPY = """,
spread AS (
  SELECT w.symbol, w.pos, p.close, row_number() OVER (PARTITION BY w.symbol, w.pos ORDER BY p.close) AS r
  FROM walk w JOIN walk p ON p.symbol = w.symbol AND p.pos <= w.pos AND p.pos > w.pos - 100
  WHERE w.pos >= 100),
edges AS (
  SELECT symbol, pos, min(close) AS e0, quantile_cont(close, 0.2::DOUBLE) AS e1, quantile_cont(close, 0.4::DOUBLE) AS e2,
         quantile_cont(close, 0.6::DOUBLE) AS e3, quantile_cont(close, 0.8::DOUBLE) AS e4, max(close) AS e5
  FROM spread GROUP BY symbol, pos),
binned AS (
  SELECT s.symbol, s.pos, CASE
      WHEN e0 = e5 THEN -1
      WHEN s.close <= e1 AND e1 > e0 THEN 1 WHEN s.close <= e2 AND e2 > e0 THEN 2
      WHEN s.close <= e3 AND e3 > e0 THEN 3 WHEN s.close <= e4 AND e4 > e0 THEN 4 ELSE 5 END AS bin
  FROM spread s JOIN edges e ON e.symbol = s.symbol AND e.pos = s.pos),
shares AS (SELECT symbol, pos, bin, count(*) / 100.0::DOUBLE AS p FROM binned GROUP BY symbol, pos, bin),
entropies AS MATERIALIZED (
  SELECT symbol, pos, CASE WHEN min(bin) = -1 THEN -(2.0::DOUBLE/3*log2(2.0::DOUBLE/3) + 1.0::DOUBLE/3*log2(1.0::DOUBLE/3))
                           ELSE -sum(p * log2(p)) END AS entropy
  FROM shares GROUP BY symbol, pos)"""

WINDOW_FEATURES = """,
ruled AS MATERIALIZED (
  SELECT symbol, pos, ts, uid, close, log_ret, pct,
         CASE WHEN close > prev THEN 1 ELSE -1 END AS tick_rule,
         (CASE WHEN close > prev THEN 1 ELSE -1 END) * volume AS imbalance,
         CASE WHEN pos >= 20 THEN avg(close) OVER w20 END AS mid,
         CASE WHEN pos >= 20 THEN 2 * stddev_pop(close) OVER w20 END AS dev,
         CASE WHEN pos >= 50 THEN avg(close) OVER w50 END AS ma_fast,
         CASE WHEN pos >= 200 THEN avg(close) OVER w200 END AS ma_slow
  FROM rets
  WINDOW w20 AS (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING),
         w50 AS (PARTITION BY symbol ORDER BY pos ROWS 49 PRECEDING),
         w200 AS (PARTITION BY symbol ORDER BY pos ROWS 199 PRECEDING)),
wf AS MATERIALIZED (
  SELECT *, 2 * dev / close AS bb_width, (close - mid + dev) / (2 * dev) AS bb_position,
         CASE WHEN pos >= 20 THEN sum(imbalance) OVER (PARTITION BY symbol ORDER BY pos ROWS 19 PRECEDING) END
           AS cumulative_imbalance,
         (ma_fast - ma_slow) / ma_slow AS trend_strength
  FROM ruled)"""


def imbalance_bars(thresholds: str) -> str:
    """Recursive bar building over ``ticks``; ``thresholds`` is a query giving symbol, threshold."""
    return f""",
moves AS (
  SELECT *, row_number() OVER w AS pos,
         CASE WHEN price > lag(price) OVER w THEN 1 WHEN price < lag(price) OVER w THEN -1 END AS moved
  FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, uid)),
signed AS MATERIALIZED (
  SELECT symbol, ts, uid, price, volume, pos,
         coalesce(last_value(moved IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos
                  ROWS UNBOUNDED PRECEDING), 1) AS sign
  FROM moves),
limits AS MATERIALIZED ({thresholds}),
folded AS (
  SELECT s.symbol, l.threshold, 0::BIGINT AS pos, NULL::TIMESTAMP AS ts, true AS closed, 0.0::DOUBLE AS theta,
         0.0::DOUBLE AS o, 0.0::DOUBLE AS hi, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS c, 0.0::DOUBLE AS vol, 0.0::DOUBLE AS dol
  FROM (SELECT DISTINCT symbol FROM signed) s JOIN limits l ON l.symbol = s.symbol
  UNION ALL
  SELECT s.symbol, f.threshold, s.pos, s.ts,
         abs(CASE WHEN f.closed THEN 0 ELSE f.theta END + s.sign * (s.price * s.volume)) >= f.threshold,
         CASE WHEN f.closed THEN 0 ELSE f.theta END + s.sign * (s.price * s.volume),
         CASE WHEN f.closed THEN s.price ELSE f.o END,
         CASE WHEN f.closed THEN s.price ELSE greatest(f.hi, s.price) END,
         CASE WHEN f.closed THEN s.price ELSE least(f.lo, s.price) END,
         s.price,
         CASE WHEN f.closed THEN 0 ELSE f.vol END + s.volume,
         CASE WHEN f.closed THEN 0 ELSE f.dol END + s.price * s.volume
  FROM folded f JOIN signed s ON s.symbol = f.symbol AND s.pos = f.pos + 1),
ibars AS MATERIALIZED (
  SELECT symbol, ts, o AS open, hi AS high, lo AS low, c AS close, vol AS volume,
         CASE WHEN vol > 0 THEN dol / vol ELSE c END AS vwap
  FROM folded WHERE closed AND pos > 0)"""


THRESHOLD_SQL = """
  SELECT symbol, count(*) FILTER (moved = 1) AS ups, count(*) FILTER (moved = -1) AS downs,
         CASE WHEN count(moved) = 0 THEN 1000000.0::DOUBLE ELSE greatest(
           5000 * greatest(abs(2 * (count(*) FILTER (moved = 1))::DOUBLE / count(moved) - 1), 0.01::DOUBLE)
                * avg(price * volume), 1000.0::DOUBLE) END AS threshold
  FROM moves GROUP BY symbol"""

DAILY = (
    WALK
    + """,
daily AS MATERIALIZED (
  SELECT symbol, CAST(ts AS DATE) AS date, max_by(close, pos) AS close FROM walk GROUP BY ALL)"""
)

ALIGNED = (
    DAILY
    + """,
cells AS (SELECT s.symbol, d.date FROM (SELECT DISTINCT symbol FROM daily) s, (SELECT DISTINCT date FROM daily) d),
filled AS (
  SELECT c.symbol, c.date, last_value(d.close IGNORE NULLS) OVER (PARTITION BY c.symbol ORDER BY c.date
         ROWS UNBOUNDED PRECEDING) AS close
  FROM cells c LEFT JOIN daily d ON d.symbol = c.symbol AND d.date = c.date),
dret AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM filled),
aligned AS MATERIALIZED (
  SELECT symbol, date, ret FROM dret
  WHERE date IN (SELECT date FROM dret GROUP BY date
                 HAVING count(ret) = (SELECT count(DISTINCT symbol) FROM daily)))"""
)

CALENDAR = """
span AS (SELECT CAST(min(ts) AS DATE) AS lo, CAST(max(ts) AS DATE) AS hi FROM events),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
calendar AS MATERIALIZED (
  SELECT date FROM days
  WHERE isodow(date) < 6 AND date <> (SELECT min(date) FROM days WHERE isodow(date) = 1))"""

UNIVERSE = """
listed AS (SELECT DISTINCT event_type AS symbol FROM events UNION ALL SELECT 'absent'),
universe AS MATERIALIZED (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS rank FROM listed)"""


def ask(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{body.strip()}"
