"""Frames written to the shared folder: their estimates, and when their files go."""

import os
import time

from tickloom import session
from tickloom.operators import ordered, pipeline
from tickloom.session import collect_unused, reliable
from tickloom.sources import tables


def test_estimates_of_written_frames_do_not_multiply(spark):
    df = spark.range(50).withColumnRenamed("id", "n")
    for _ in range(4):
        df = reliable(df.join(df.select("n"), "n"))
    assert ordered.estimated_bytes(df) < 1 << 20
    assert sorted(r["n"] for r in df.collect()) == list(range(50))


def test_an_estimate_of_thousands_of_digits(spark):
    spark.sparkContext.setCheckpointDir(session.shared_dir(spark))
    df = spark.range(50).withColumnRenamed("id", "n")
    for _ in range(12):
        df = df.join(df.select("n"), "n").checkpoint()
    assert ordered.estimated_bytes(df) > 1 << 60


def test_files_go_when_no_frame_reads_them(spark):
    def folder(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    first, second = reliable(spark.range(10)), reliable(spark.range(20))
    derived, gone, kept = second.where("id > 4").join(second, "id"), folder(first), folder(second)
    del first, second
    for _ in range(20):
        collect_unused(spark)
        if not os.path.exists(gone):
            break
        time.sleep(0.5)
    assert not os.path.exists(gone) and os.path.exists(kept)
    assert derived.count() == 15


def test_the_feature_frame_is_written_once(spark, monkeypatch, small_blocks):
    """Also of symbols too large for one task, whose runs hold the columns of the bars only."""
    written, rewritten = [], session.rewritten
    monkeypatch.setattr(session, "rewritten", lambda df, label: (written.append(df.columns), rewritten(df, label))[1])
    small_blocks(500)
    frame = pipeline.feature_frame(tables.bars_history(spark, "/root/testdata/sf0.001"))
    assert frame.count() > 0
    assert sum("entropy" in columns for columns in written) == 1
    assert not any("l_orderkey" in columns for columns in written)
