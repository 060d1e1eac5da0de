"""Session settings and the shared working folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on; everything else is the cluster's business.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark's own defaults; operators on long texts use smaller batches in the session they share.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864b",
    # Archives written from nanosecond indexes hold TIMESTAMP(NANOS) columns.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
}


def build_session(master: str | None = None, app: str = "tickloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Put the library's runtime settings on a session somebody else made."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh local one only on a local master that has none set."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fresh = tempfile.mkdtemp(prefix="tickloom-checkpoints-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``fresh_path`` named and that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor costs a re-read only; partitions stay as they are."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def reliable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so a lost executor costs a re-read only."""
    return rewritten(df, "rows")


def rewritten(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again, in a columnar form.

    Its size estimate is that of its files. A checkpoint keeps the estimate of what it was made from, which joins multiply: after some
    rounds it has thousands of digits. The files go when no frame reads them any more.
    """
    spark = df.sparkSession
    held = _held.setdefault(spark.sparkContext.applicationId, _Held())
    if held.fresh >= TIDY_BYTES:
        collect_unused(spark)
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    files = made._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    held.paths[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(files)
    size = files.sizeInBytes()
    del files
    held.fresh += size
    if size >= TIDY_BYTES:
        collect_unused(spark)
    return made


# Bytes written after which frames that nothing reads any more are looked for, and with them the shuffles behind them.
TIDY_BYTES = 32 << 20


class _Held:
    """Written frames of a session by path, each with a weak reference of the JVM to the list of files that every plan over it shares."""

    def __init__(self) -> None:
        self.paths: dict[str, object] = {}
        self.fresh = 0


_held: dict[str, _Held] = {}


def collect_unused(spark: SparkSession) -> None:
    """Let the JVM find what nothing refers to, and remove its files: shuffles by Spark's own cleaner, written frames here."""
    held = _held.setdefault(spark.sparkContext.applicationId, _Held())
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    for path in [path for path, files in held.paths.items() if files.get() is None]:
        del held.paths[path]
        discard(spark, path)
    held.fresh = 0
