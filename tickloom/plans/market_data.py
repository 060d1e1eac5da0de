"""Queries over ticks and bars: sources, sinks, calendars, quality, bar building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import clean, market
from tickloom.operators import bars as bar_ops
from tickloom.operators import portfolio, quality
from tickloom.operators.ordered import keep_first
from tickloom.plans import sql
from tickloom.plans.registry import query
from tickloom.session import fresh_path
from tickloom.sources import archive, tables

AS_OF = "2024-01-31"
FIXED_LIMIT = 20_000.0


def r(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def as_text(*names: str) -> dict:
    """Dates as ISO text, which both engines print alike."""
    return {name: F.col(name).cast("string") for name in names}


def fixed_thresholds(ticks: DataFrame, limit: float = FIXED_LIMIT) -> DataFrame:
    return ticks.select("symbol").distinct().withColumn("threshold", F.lit(limit))


def trades_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade messages made of events: two condition codes, exchange from the user."""
    events = tables.read_table(spark, sf_dir, "events")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("uid"),
        F.col("ts").alias("t"),
        F.col("value").alias("p"),
        F.get_json_object("props", "$.k").cast("double").alias("s"),
        F.array(F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")), F.lit("T")).alias("c"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("x"), (F.col("user_id") % 3).cast("string"))).alias("x"),
    )


# --- sources --------------------------------------------------------------------------------


@query(
    "scan_tick_archive",
    sql.ask(
        sql.TICKS,
        """SELECT symbol, uid, ts, CAST(CAST(price AS FLOAT) AS DOUBLE) AS price, volume FROM ticks""",
    ),
)
def scan_tick_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "archive")
    archive.write_archive(tables.ticks_events(spark, sf_dir), root, AS_OF)
    return archive.scan_tick_archive(spark, root).select("symbol", "uid", "ts", "price", "volume")


@query(
    "load_ticks_range",
    sql.ask(
        sql.TICKS,
        """SELECT symbol, ts, price, volume FROM ticks
        WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""",
    ),
)
def load_ticks_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.load_ticks_range(
        tables.ticks_events(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-20 12:00:00"
    )


BARS_OUT = """SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
       round(close, 6) AS close, round(volume, 6) AS volume, round(vwap, 8) AS vwap FROM ibars"""
FIXED_BARS = sql.ask(
    sql.TICKS + sql.imbalance_bars("SELECT DISTINCT symbol, 20000.0::DOUBLE AS threshold FROM ticks"), BARS_OUT
)


def _bars_out(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", *(r(c) for c in ("open", "high", "low", "close", "volume")), r("vwap", 8))


@query("load_bars", FIXED_BARS)
def load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = tables.ticks_events(spark, sf_dir)
    root = fresh_path(spark, "bars")
    archive.write_bars(bar_ops.dollar_imbalance_bars(ticks, fixed_thresholds(ticks)), root)
    return _bars_out(archive.load_bars(spark, root))


@query(
    "recent_bars",
    sql.ask(
        sql.WALK,
        """SELECT symbol, ts, close, volume FROM walk WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY
        AND symbol IN (SELECT symbol FROM walk WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY
                       GROUP BY symbol HAVING count(*) >= 200)""",
    ),
)
def recent_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.bars_walk(spark, sf_dir).select("symbol", "ts", "close", "volume")
    return archive.recent_bars(bars, AS_OF, days=10)


@query(
    "ticks_from_trades",
    """SELECT event_type AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
       concat('c', user_id % 5, ',T') AS conditions,
       CASE WHEN user_id % 3 <> 0 THEN concat('x', user_id % 3) ELSE '' END AS tape FROM events""",
)
def ticks_from_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.ticks_from_trades(trades_raw(spark, sf_dir))


TIME_BARS = """tb AS (SELECT symbol, date_trunc('{unit}', ts) AS ts, min_by(price, (ts, uid)) AS open, max(price) AS high,
       min(price) AS low, max_by(price, (ts, uid)) AS close, sum(volume) AS volume
       FROM ticks GROUP BY symbol, date_trunc('{unit}', ts))"""


@query("time_bars", sql.ask(f"{sql.TICKS}, {TIME_BARS.format(unit='minute')}", "SELECT * FROM tb"))
def time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.time_bars(tables.ticks_events(spark, sf_dir))


@query(
    "last_time_bars",
    sql.ask(
        f"{sql.TICKS}, {TIME_BARS.format(unit='minute')}",
        "SELECT * FROM tb QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100",
    ),
)
def last_time_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.last_bars(bar_ops.time_bars(tables.ticks_events(spark, sf_dir)), 100)


# --- sinks ----------------------------------------------------------------------------------


@query(
    "dedup_ticks",
    sql.ask(
        sql.TICKS,
        """SELECT symbol, date_trunc('day', ts) AS ts, floor(price / 10) AS price, floor(volume / 10) AS volume,
        min(uid) AS uid FROM ticks GROUP BY ALL""",
    ),
)
def dedup_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = tables.ticks_events(spark, sf_dir).select(
        "symbol",
        "uid",
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"),
        F.floor(F.col("price") / 10).cast("double").alias("price"),
        F.floor(F.col("volume") / 10).cast("double").alias("volume"),
    )
    return archive.dedup_ticks(coarse)


@query(
    "archive_ticks",
    sql.ask(
        sql.TICKS,
        """SELECT symbol, uid, ts AS timestamp, CAST(price AS FLOAT) AS price, CAST(floor(volume) AS BIGINT) AS size,
        CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM ticks WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY""",
    ),
)
def archive_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_rows(tables.ticks_events(spark, sf_dir), AS_OF, days=20).withColumns(as_text("date"))


@query(
    "write_bars",
    sql.ask(
        f"{sql.TICKS}, {TIME_BARS.format(unit='hour')}, {TIME_BARS.format(unit='day').replace('tb AS', 'td AS')}",
        """SELECT * FROM tb UNION ALL
        SELECT * FROM td WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.symbol = td.symbol AND tb.ts = td.ts)""",
    ),
)
def write_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = tables.ticks_events(spark, sf_dir)
    chunks = bar_ops.time_bars(ticks, "1 hour").withColumn("seq", F.lit(0)).unionByName(
        bar_ops.time_bars(ticks, "1 day").withColumn("seq", F.lit(1))
    )
    root = fresh_path(spark, "bars")
    archive.write_bars(bar_ops.first_bar_per_time(chunks).drop("seq"), root)
    return archive.load_bars(spark, root)


@query(
    "ingest_status",
    sql.ask(
        sql.TICKS,
        """SELECT symbol, ['pending', 'active', 'archived'][k % 3 + 1] AS status, CAST(CAST(ts AS DATE) AS VARCHAR) AS last_date
        FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY uid DESC) = 1""",
    ),
)
def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.array(F.lit("pending"), F.lit("active"), F.lit("archived"))
    log = tables.ticks_events(spark, sf_dir).select(
        "symbol",
        F.get(states, (F.col("volume") % 3).cast("int")).alias("status"),
        F.to_date("ts").alias("last_date"),
        F.col("uid").alias("seq"),
    )
    return archive.latest_status(log).withColumns(as_text("last_date"))


# --- projections ----------------------------------------------------------------------------


@query(
    "normalize_columns",
    """SELECT event_type AS symbol, event_id AS uid, ts AS timestamp, value AS price,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, concat('c', user_id % 5, '|T') AS condition,
       CASE WHEN user_id % 3 <> 0 THEN concat('x', user_id % 3) END AS exchange FROM events""",
)
def normalize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = clean.normalize_columns(trades_raw(spark, sf_dir), volume=True)
    return named.withColumn("condition", F.concat_ws("|", "condition"))


@query(
    "parse_mixed_ts",
    """SELECT event_id AS uid, CASE event_id % 5 WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('day', ts)
       WHEN 4 THEN ts - INTERVAL 2 HOUR ELSE ts END AS ts FROM events""",
)
def parse_mixed_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    text = (
        F.when(F.col("event_id") % 5 == 0, F.date_format("ts", micros))
        .when(F.col("event_id") % 5 == 1, F.concat(F.date_format("ts", micros), F.lit("Z")))
        .when(F.col("event_id") % 5 == 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("event_id") % 5 == 3, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.concat(F.date_format("ts", micros), F.lit("+02:00")))
    )
    events = tables.read_table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("uid"), clean.parse_mixed_ts(text).alias("ts"))


@query(
    "is_trading_day",
    sql.ask(
        sql.CALENDAR,
        """SELECT event_id AS uid, CAST(ts AS DATE) IN (SELECT date FROM calendar) AS is_trading_day FROM events""",
    ),
)
def is_trading_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("uid"), "ts")
    return market.with_trading_day(events, F.to_date("ts"), tables.calendar(spark, sf_dir)).drop("ts")


@query(
    "is_market_open",
    sql.ask(
        sql.CALENDAR,
        """SELECT event_id AS uid, CAST(ts - INTERVAL 5 HOUR AS DATE) IN (SELECT date FROM calendar)
        AND CAST(ts - INTERVAL 5 HOUR AS TIME) BETWEEN TIME '09:30:00' AND TIME '16:00:00' AS is_market_open
        FROM events""",
    ),
)
def is_market_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events fall into January, five hours behind UTC."""
    events = tables.read_table(spark, sf_dir, "events").select(F.col("event_id").alias("uid"), "ts")
    return market.with_market_open(events, F.col("ts"), tables.calendar(spark, sf_dir)).drop("ts")


@query(
    "string_date",
    """SELECT s_suppkey AS id, replace(replace(s_name, '.', '_'), '-', '_') AS safe_name, upper(s_name) AS upper_name
       FROM supplier""",
)
def string_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = tables.read_table(spark, sf_dir, "supplier")
    return supplier.select(
        F.col("s_suppkey").alias("id"),
        clean.safe_symbol("s_name").alias("safe_name"),
        F.upper("s_name").alias("upper_name"),
    )


# --- reports --------------------------------------------------------------------------------


@query(
    "missing_days",
    sql.ask(
        f"{sql.CALENDAR}, {sql.UNIVERSE}, {sql.TICKS}",
        """SELECT u.symbol, CAST(c.date AS VARCHAR) AS date FROM universe u, calendar c
        WHERE NOT EXISTS (SELECT 1 FROM ticks t WHERE t.symbol = u.symbol AND CAST(t.ts AS DATE) = c.date
                          AND (t.uid + dayofmonth(c.date)) % 7 <> 0 AND t.k < 5)""",
    ),
)
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps after a rule drops most ticks, so that some days go missing."""
    ticks = tables.ticks_events(spark, sf_dir)
    thinned = ticks.filter(((F.col("uid") + F.dayofmonth("ts")) % 7 != 0) & (F.col("volume") < 5))
    found = quality.missing_days(tables.universe(spark, sf_dir), tables.calendar(spark, sf_dir), thinned)
    return found.withColumns(as_text("date"))


@query(
    "coverage_report",
    sql.ask(
        f"{sql.UNIVERSE}, {sql.TICKS}",
        """SELECT u.symbol, count(DISTINCT CAST(ts AS DATE)) AS days, CAST(min(CAST(ts AS DATE)) AS VARCHAR) AS first_day,
        CAST(max(CAST(ts AS DATE)) AS VARCHAR) AS last_day, CASE WHEN count(ts) = 0 THEN 'MISSING'
        WHEN count(DISTINCT CAST(ts AS DATE)) >= 240 THEN 'OK' ELSE 'LOW' END AS status
        FROM universe u LEFT JOIN ticks t ON t.symbol = u.symbol GROUP BY u.symbol""",
    ),
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.coverage_report(tables.universe(spark, sf_dir), tables.ticks_events(spark, sf_dir))
    return found.withColumns(as_text("first_day", "last_day"))


@query(
    "coverage_report_wide",
    """WITH t AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS day FROM lineitem)
       SELECT CAST(s_suppkey AS VARCHAR) AS symbol, count(DISTINCT day) AS days, CAST(min(day) AS VARCHAR) AS first_day,
       CAST(max(day) AS VARCHAR) AS last_day, CASE WHEN count(day) = 0 THEN 'MISSING' WHEN count(DISTINCT day) >= 240 THEN 'OK'
       ELSE 'LOW' END AS status
       FROM supplier LEFT JOIN t ON t.symbol = CAST(s_suppkey AS VARCHAR) GROUP BY s_suppkey""",
)
def coverage_report_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report over many symbols."""
    suppliers = tables.read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("symbol"))
    found = quality.coverage_report(suppliers, tables.ticks_lineitem(spark, sf_dir))
    return found.withColumns(as_text("first_day", "last_day"))


TABLE_NAMES = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
]


# The driver's tables are given as one file or a folder of files each, so sizes are in the tests; here: rows and status by rows.
@query(
    "archive_inventory",
    " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS rows, false AS corrupt, count(*) < 50000 AS low_rows FROM {name}" for name in TABLE_NAMES
    ),
)
def archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.archive_inventory(spark, sf_dir, "symbol string")
    name = F.regexp_extract("path", r"([a-z]+)\.parquet(?:/[^/]*)?$", 1)
    by_table = found.groupBy(name.alias("name")).agg(
        F.sum("rows").alias("rows"), F.max(F.col("status") == "CORRUPT").alias("corrupt")
    )
    return by_table.select("name", "rows", "corrupt", (F.col("rows") < quality.HEALTHY_ROWS).alias("low_rows"))


# --- bars -----------------------------------------------------------------------------------


@query("dollar_imbalance_bars", FIXED_BARS)
def dollar_imbalance_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = tables.ticks_events(spark, sf_dir)
    return _bars_out(bar_ops.dollar_imbalance_bars(ticks, fixed_thresholds(ticks)))


@query(
    "intrinsic_imbalance_bars",
    sql.ask(sql.TICKS + sql.imbalance_bars(sql.THRESHOLD_SQL), BARS_OUT),
)
def intrinsic_imbalance_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: threshold of every symbol from its own ticks, then the bars."""
    ticks = tables.ticks_events(spark, sf_dir)
    return _bars_out(bar_ops.dollar_imbalance_bars(ticks, bar_ops.imbalance_threshold(ticks)))


@query(
    "imbalance_bars_wide",
    sql.ask(
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_partkey,
              l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS uid
              FROM lineitem),
        ticks AS MATERIALIZED (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_shipdate AS ts, uid,
              l_extendedprice / l_quantity AS price, l_quantity AS volume FROM ranked)"""
        + sql.imbalance_bars("SELECT DISTINCT symbol, 200000.0::DOUBLE AS threshold FROM ticks"),
        """SELECT symbol, count(*) AS bars, round(sum(volume), 4) AS volume, max(ts) AS last_ts,
        round(avg(vwap), 4) AS mean_vwap FROM ibars GROUP BY symbol""",
    ),
)
def imbalance_bars_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many symbols with tied timestamps, ordered by whole rows."""
    ticks = tables.ticks_lineitem(spark, sf_dir)
    bars = bar_ops.dollar_imbalance_bars(ticks, fixed_thresholds(ticks, 200_000.0))
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.round(F.sum("volume"), 4).alias("volume"),
        F.max("ts").alias("last_ts"),
        F.round(F.avg("vwap"), 4).alias("mean_vwap"),
    )


@query(
    "imbalance_threshold",
    sql.ask(
        sql.TICKS + sql.imbalance_bars(sql.THRESHOLD_SQL).split("signed AS")[0].rstrip().rstrip(",")
        + f", limits AS ({sql.THRESHOLD_SQL})",
        "SELECT symbol, ups, downs, round(threshold, 4) AS threshold FROM limits",
    ),
)
def imbalance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bar_ops.imbalance_threshold(tables.ticks_events(spark, sf_dir))
    return found.select("symbol", "ups", "downs", r("threshold", 4))


@query(
    "tick_sign",
    sql.ask(
        sql.TICKS
        + sql.imbalance_bars("SELECT DISTINCT symbol, 1.0::DOUBLE AS threshold FROM ticks").split("limits AS")[0].rstrip().rstrip(","),
        "SELECT symbol, uid, price, CAST(sign AS INTEGER) AS sign FROM signed",
    ),
)
def tick_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.tick_sign(tables.ticks_events(spark, sf_dir)).select("symbol", "uid", "price", "sign")


@query(
    "dedup_keep_first",
    sql.ask(
        sql.TICKS,
        """SELECT symbol, date_trunc('hour', ts) AS ts, min_by(price, uid) AS price, min(uid) AS uid FROM ticks
        GROUP BY ALL""",
    ),
)
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = tables.ticks_events(spark, sf_dir).select(
        "symbol", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "price", "uid"
    )
    return keep_first(hourly, ["symbol", "ts"], ["uid"])


# --- universe -------------------------------------------------------------------------------


@query("top_universe", sql.ask(sql.UNIVERSE, "SELECT symbol, rank FROM universe WHERE rank < 3"))
def top_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.top_universe(tables.universe(spark, sf_dir), 3)
