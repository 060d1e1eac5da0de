"""Small tables made by hand or by a seeded generator."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

START = datetime(2024, 3, 4, 14, 30)
TICKS = "symbol string, ts timestamp_ntz, uid bigint, price double, volume double"


def minutes(n: float) -> datetime:
    return START + timedelta(minutes=n)


def ticks(spark, rows, symbol="A"):
    """``rows`` of (price, volume), one minute apart."""
    data = [(symbol, minutes(i), i, float(p), float(v)) for i, (p, v) in enumerate(rows)]
    return spark.createDataFrame(data, TICKS)


def skewed_ticks(seed: int, sizes: dict[str, int], ties: bool = False) -> pd.DataFrame:
    """Random walks of given lengths; with ``ties`` many ticks share a time."""
    rng = np.random.default_rng(seed)
    parts = []
    for symbol, n in sizes.items():
        step = np.sort(rng.integers(0, max(1, n // 4) if ties else 50 * n, n))
        parts.append(
            pd.DataFrame(
                {
                    "symbol": symbol,
                    "ts": pd.Timestamp(START) + pd.to_timedelta(step, unit="s"),
                    "uid": np.arange(n),
                    "price": np.round(100 + np.cumsum(rng.integers(-3, 4, n)) * 0.25, 2),
                    "volume": rng.integers(0, 20, n).astype(float),
                }
            )
        )
    frame = pd.concat(parts, ignore_index=True)
    if not ties:
        frame["ts"] = frame["ts"] + pd.to_timedelta(frame["uid"], unit="us")
    return frame


def to_spark(spark, frame: pd.DataFrame):
    """Shuffled rows, so that nothing rests on input order."""
    mixed = frame.sample(frac=1.0, random_state=7)
    df = spark.createDataFrame(mixed)
    return df.withColumn("ts", df["ts"].cast("timestamp_ntz")).repartition(5)


def rows_of(df, *order):
    return df.orderBy(*order).toPandas().reset_index(drop=True)
