from datetime import date, datetime

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from data import minutes, rows_of, ticks
from tickloom.functions import clean, market, trading
from tickloom.operators import quality
from tickloom.sources import archive
from tickloom.sources.universe import SYMBOLS, universe


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("2024-01-02T03:04:05Z", datetime(2024, 1, 2, 3, 4, 5)),
        ("2024-01-02T03:04:05.123456Z", datetime(2024, 1, 2, 3, 4, 5, 123456)),
        ("2024-01-02 03:04:05.5", datetime(2024, 1, 2, 3, 4, 5, 500000)),
        ("2024-01-02T03:04:05-05:00", datetime(2024, 1, 2, 8, 4, 5)),
        ("2024-01-02", datetime(2024, 1, 2)),
        ("soon", None),
        (None, None),
    ],
)
def test_mixed_times(spark, text, wanted):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean.parse_mixed_ts("t")).first()[0] == wanted


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2.0, 3, "a", "b")], "t int, p double, vol int, c string, x string")
    assert clean.normalize_columns(df).columns == ["timestamp", "price", "size", "condition", "exchange"]
    assert clean.normalize_columns(df, volume=True).columns[2] == "volume"


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("-inf"),), (None,)], "x double")
    assert [r[0] for r in df.select(clean.finite("x")).collect()] == [1.0, None, None, None]


def test_trades_become_ticks(spark):
    schema = "symbol string, t timestamp, p double, s double, c array<string>, x string"
    df = spark.createDataFrame([("A", datetime(2024, 1, 2), 1.5, 3.0, ["@", "I"], "V"), ("A", datetime(2024, 1, 2), 1.5, 3.0, None, None)], schema)
    rows = [tuple(r) for r in archive.ticks_from_trades(df).select("conditions", "tape").collect()]
    assert rows == [("@,I", "V"), ("", "")]


def test_market_hours_follow_daylight_saving(spark):
    rows = [
        (datetime(2024, 1, 3, 14, 30), True),  # winter: 09:30
        (datetime(2024, 1, 3, 14, 29, 59), False),
        (datetime(2024, 1, 3, 21, 0), True),  # 16:00 is still open
        (datetime(2024, 1, 3, 21, 0, 0, 1), False),
        (datetime(2024, 7, 3, 13, 30), True),  # summer: 09:30
        (datetime(2024, 7, 4, 15, 0), False),  # holiday
        (datetime(2024, 7, 6, 15, 0), False),  # Saturday, although listed
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, wanted boolean")
    days = spark.createDataFrame([(date(2024, 1, 3),), (date(2024, 7, 3),), (date(2024, 7, 6),)], "date date")
    got = market.with_market_open(df, F.col("ts"), days)
    assert all(r["wanted"] == r["is_market_open"] for r in got.collect())


def test_archive_round_trip_and_types(spark, tmp_path):
    df = ticks(spark, [(1.1, 2.7), (2.0, 1)], "A").union(ticks(spark, [(3.0, 1)], "B"))
    archive.write_archive(df, str(tmp_path / "a"), "2024-03-05")
    stored = spark.read.parquet(str(tmp_path / "a"))
    assert dict(stored.dtypes)["price"] == "float" and dict(stored.dtypes)["size"] == "bigint"
    back = rows_of(archive.scan_tick_archive(spark, str(tmp_path / "a")), "symbol", "ts")
    assert back["volume"].tolist() == [2.0, 1.0, 1.0]
    assert back["ts"].tolist() == [minutes(0), minutes(1), minutes(0)]


def test_archive_prunes_partitions_and_columns(spark, tmp_path):
    archive.write_archive(ticks(spark, [(1, 1), (2, 1)]), str(tmp_path / "a"), "2024-03-05")
    df = archive.scan_tick_archive(spark, str(tmp_path / "a")).filter("symbol = 'A'").select("ts", "price")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan
    assert "ReadSchema: struct<timestamp:timestamp_ntz,price:float>" in plan


def test_nanosecond_bars_are_read(spark, tmp_path):
    times = pa.array([1_704_164_645_123_456_789], pa.timestamp("ns"))
    (tmp_path / "symbol=A").mkdir()
    pq.write_table(pa.table({"timestamp": times, "close": [1.0]}), tmp_path / "symbol=A" / "bars.parquet")
    row = archive.load_bars(spark, str(tmp_path)).first()
    assert row["ts"] == datetime(2024, 1, 2, 3, 4, 5, 123456)


def test_unreadable_file_is_skipped_and_reported(spark, tmp_path):
    good = pd.DataFrame({"symbol": ["A"] * 10, "price": 1.0})
    good.to_parquet(tmp_path / "good.parquet")
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 not really")
    got = rows_of(quality.archive_inventory(spark, str(tmp_path), "symbol string"), "path")
    assert got["status"].tolist() == ["CORRUPT", "TINY FILE"]
    assert not got["archived"].any()


def test_an_empty_file_is_not_corrupt(spark, tmp_path):
    pd.DataFrame({"symbol": pd.Series([], dtype=str)}).to_parquet(tmp_path / "empty.parquet")
    got = quality.archive_inventory(spark, str(tmp_path), "symbol string").first()
    assert (got["status"], got["rows"]) == ("TINY FILE", 0)


def test_first_layout_wins(spark, tmp_path):
    for folder in ("data/A/parquet", "A/parquet", "B/parquet"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "x.parquet").write_bytes(b"")
    root = str(tmp_path)
    assert archive.first_layout(spark, root, "A") == f"{root}/data/A/parquet"
    assert archive.first_layout(spark, root, "B") == f"{root}/B/parquet"
    assert archive.first_layout(spark, root, "C") is None


def test_dedup_keeps_the_first_insert(spark):
    rows = [("A", minutes(0), 3, 1.0, 1.0), ("A", minutes(0), 1, 1.0, 1.0), ("A", minutes(0), 2, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, uid bigint, price double, volume double")
    assert rows_of(archive.dedup_ticks(df), "uid")["uid"].tolist() == [1, 2]


def test_missing_days_are_exact(spark):
    days = [date(2024, 3, 4), date(2024, 3, 5), date(2024, 3, 6)]
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    names = spark.createDataFrame([("A", 0), ("B", 1)], "symbol string, rank int")
    got = quality.missing_days(names, calendar, ticks(spark, [(1, 1)]), days=1)
    assert sorted(tuple(r) for r in got.collect()) == [(n, d) for n in "AB" for d in days[1:]]


def test_coverage_statuses(spark):
    names = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "symbol string, rank int")
    df = ticks(spark, [(1, 1)]).union(ticks(spark, [(1, 1)], "B").selectExpr("symbol", "ts + interval 1 day", "uid", "price", "volume")).union(ticks(spark, [(1, 1)], "B"))
    got = quality.coverage_report(names, df, required_days=2)
    assert {r["symbol"]: r["status"] for r in got.collect()} == {"A": "LOW", "B": "OK", "C": "MISSING"}


def test_sell_side_costs_more(spark):
    df = spark.createDataFrame([(100.0, 100_000.0)], "p double, q double")
    buy, sell = df.select(
        trading.trade_cost(F.col("p"), F.col("q"), F.lit(1)), trading.trade_cost(F.col("p"), F.col("q"), F.lit(-1))
    ).first()
    assert buy == pytest.approx(1000.0)
    assert sell == pytest.approx(1000.0 + 80.0 + 8.30)  # per-share fee is capped


def test_universe(spark):
    assert len(SYMBOLS) == len(set(SYMBOLS)) == 114
    got = universe(spark)
    assert got.count() == 114 and got.filter("rank = 0").first()["symbol"] == "QQQ"


def test_recent_bars_needs_enough_rows(spark):
    df = ticks(spark, [(1, 1)] * 5).union(ticks(spark, [(1, 1)] * 2, "B"))
    got = archive.recent_bars(df, "2024-03-05", days=1, least=5)
    assert {r["symbol"] for r in got.collect()} == {"A"}


def test_plain_layouts_are_read_in_one_scan(spark, tmp_path):
    def put(folder, price):
        (tmp_path / folder).mkdir(parents=True)
        rows = pd.DataFrame({"timestamp": pd.to_datetime(["2024-01-02 15:00"]).astype("datetime64[us]"), "price": [price], "size": [3]})
        rows.to_parquet(tmp_path / folder / "part.parquet")

    for folder, price in (("data/A/parquet", 1.0), ("A/parquet", 2.0), ("B/parquet", 3.0)):
        put(folder, price)
    got = archive.scan_tick_archive(spark, str(tmp_path))
    assert sorted((r["symbol"], r["price"], r["volume"]) for r in got.collect()) == [("A", 1.0, 3.0), ("B", 3.0, 3.0)]


def test_bar_files_take_their_symbol_from_the_path(spark, tmp_path):
    for symbol in "AB":
        (tmp_path / symbol / "bars").mkdir(parents=True)
        rows = pd.DataFrame({"timestamp": pd.to_datetime(["2024-01-02 15:00"]).astype("datetime64[us]"), "close": [1.0]})
        rows.to_parquet(tmp_path / symbol / "bars" / f"{symbol}_dollar_bars.parquet")
    assert sorted(r["symbol"] for r in archive.load_bars(spark, str(tmp_path)).collect()) == ["A", "B"]


def test_status_log(spark, tmp_path):
    path = str(tmp_path / "log")
    symbols = spark.createDataFrame([("A",), ("B",), ("C",)], "symbol string")
    for rows in ([("A", "active", date(2024, 1, 2)), ("B", "active", date(2024, 1, 3))], [("A", "archived", date(2024, 1, 4))]):
        archive.append_status(spark, spark.createDataFrame(rows, "symbol string, status string, last_date date"), path)
    log = spark.read.parquet(path)
    assert sorted(log.select("seq").distinct().toPandas()["seq"]) == [1, 2]
    left = sorted(tuple(r) for r in archive.symbols_to_load(symbols, log).collect())
    assert left == [("B", "active", date(2024, 1, 3)), ("C", "pending", None)]
    with pytest.raises(Exception, match="unknown status"):
        archive.append_status(spark, spark.createDataFrame([("A", "lost", None)], "symbol string, status string, last_date date"), path)
