"""Helpers that the corpus operators share: Arrow passes over texts, written tables, 128-bit keys.

Operators read the columns they are told to and name their own working columns with two
leading underscores, so extra columns of a table, whatever their names, stay out of the way.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import fresh_path

# Whole texts can be long: few rows to an Arrow batch, and a bound on its bytes where Spark knows one.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Drop the shuffle files of results that have been written: Spark does it once nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def as_bytes(column: str) -> F.Column:
    return F.col(f"`{column}`").cast("string").cast("binary")


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns every text operator needs: ``__id`` long and ``__text`` UTF-8 bytes."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), as_bytes(text_col).alias("__text"))


def batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``step`` over every Arrow batch; empty results are left out."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows and (out := step(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def with_columns(
    df: DataFrame,
    text_col: str,
    compute: Callable[[list[bytes | None]], list[pa.Array]],
    fields: list[T.StructField],
) -> DataFrame:
    """All rows and columns of ``df``, and ``fields`` that ``compute`` makes from the text bytes."""
    names = [f"__c{i}" for i in range(len(df.columns))]
    held = df.toDF(*names)
    held = held.withColumn("__text", held[names[df.columns.index(text_col)]].cast("string").cast("binary"))
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema)] + fields)
    extra = [f.name for f in fields]

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = compute(batch.column(batch.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*names, *extra])

    return batches(held, step, schema).toDF(*df.columns, *extra)
