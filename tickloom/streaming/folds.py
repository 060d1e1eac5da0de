"""The batch folds on a stream: same step functions, state kept per key.

Rows of a micro-batch arrive in no order, and a later batch may bring earlier ticks.  Each
key therefore holds its rows until the watermark has passed them, then folds them in time
order; rows behind the watermark are dropped and counted by Spark.  The result equals the
batch fold over the rows the watermark has passed, however the input was cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.folds import Fold

# Waiting rows as bytes: in lists every number is pickled and boxed by itself, on its way out and on its way in.
STATE_SCHEMA = "fold array<double>, times binary, ids binary, numbers binary"


def with_event_time(df: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Watermarks need a zoned timestamp; ``ts`` stays as it is."""
    return df.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", delay)


def stream_fold(df: DataFrame, key: str, fold: Fold, delay: str, ts: str = "ts", uid: str = "uid") -> DataFrame:
    """Emitted rows of ``fold`` per key, in append mode."""
    numeric = [c for c in fold.inputs if c not in (ts, uid)]
    width = len(numeric)

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried, times, ids, numbers = state.get if state.exists else (fold.initial, b"", b"", b"")
        parts = [(np.frombuffer(times, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(numbers, float).reshape(-1, width))]
        for pdf in batches:
            parts.append((pdf["_us"].to_numpy(), pdf["_uid"].to_numpy(), pdf[numeric].to_numpy(dtype=float)))
        us, uids, values = (np.concatenate(columns) for columns in zip(*parts))
        passed = state.getCurrentWatermarkMs()
        order = np.lexsort((uids, us))
        us, uids, values = us[order], uids[order], values[order]
        ready = int(np.searchsorted(us, passed * 1000, side="left"))
        after = tuple(carried)
        if ready:
            rows = {c: values[:ready, i] for i, c in enumerate(numeric)}
            rows[ts] = us[:ready].astype("datetime64[us]")
            rows[uid] = uids[:ready]
            emitted, after = fold.step(after, rows)
            out = pd.DataFrame({name: list(column) for name, column in emitted.items()})
            out.insert(0, key, keys[0])
            if len(out):
                yield out
        state.update(
            (
                [float(v) for v in after],
                us[ready:].astype(np.int64).tobytes(),
                uids[ready:].astype(np.int64).tobytes(),
                values[ready:].tobytes(),
            )
        )
        if ready < len(us):
            state.setTimeoutTimestamp(max(int(us[ready] // 1000), passed) + 1)

    timed = with_event_time(df, delay, ts)
    needed = timed.select(
        key,
        "event_time",
        F.unix_micros("event_time").alias("_us"),
        F.col(uid).alias("_uid"),
        *(F.col(c).cast("double").alias(c) for c in numeric),
    )
    schema = T.StructType([df.schema[key], *fold.emits.fields])
    return needed.groupBy(key).applyInPandasWithState(
        update, schema, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout
    )
