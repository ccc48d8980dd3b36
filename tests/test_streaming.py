"""Streams over folders of Parquet files: late rows, repetitions, restarts."""

import datetime as dt

from pyspark.sql import functions as F

from quillsift.operators.cache import latest
from quillsift.streaming import ingest

DDL = "key string, n int, ts timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def add(spark, folder, rows):
    spark.createDataFrame([(k, n, T0 + dt.timedelta(minutes=m)) for k, n, m in rows], DDL).coalesce(1).write.mode("append").parquet(folder)


def test_first_entries_and_restart(spark, tmp_path):
    folder, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    add(spark, folder, [("a", 1, 0), ("a", 2, 1), ("b", 3, 2)])
    ingest.drain(ingest.first_entries(ingest.stream_of(spark, folder), "key", "ts", "1 hour"), out, progress)
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b"]
    add(spark, folder, [("a", 4, 5), ("c", 5, 6)])
    ingest.drain(ingest.first_entries(ingest.stream_of(spark, folder), "key", "ts", "1 hour"), out, progress)
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_windows_leave_out_late_rows(spark, tmp_path):
    folder, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    counts = lambda: ingest.windowed_counts(ingest.stream_of(spark, folder), "ts", "10 minutes", ["key"], "10 minutes", "n")
    add(spark, folder, [("a", 1, 0), ("a", 2, 9), ("b", 3, 61)])
    ingest.drain(counts(), out, progress)
    add(spark, folder, [("a", 100, 3), ("b", 1, 200)])  # the first of these is an hour late
    ingest.drain(counts(), out, progress)
    got = {(r.window_start, r.key): (r.n, r.total) for r in spark.read.parquet(out).collect()}
    assert got[(T0, "a")] == (2, 3) and (T0 + dt.timedelta(minutes=60), "b") in got


def test_updated_counts_hold_every_row(spark, tmp_path):
    folder, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    counts = lambda: ingest.windowed_counts(ingest.stream_of(spark, folder), "ts", "10 minutes", ["key"], "10 minutes", "n")
    add(spark, folder, [("a", 1, 0), ("a", 2, 9), ("b", 3, 61)])
    ingest.drain_updates(counts(), out, progress)
    add(spark, folder, [("b", 5, 62), ("a", 9, 200)])
    ingest.drain_updates(counts(), out, progress)
    got = ingest.current(spark.read.parquet(out), "window_start", "key")
    assert {(r.key, r.window_start.hour, r.n, r.total) for r in got.collect()} == {("a", 0, 2, 3), ("b", 1, 2, 8), ("a", 3, 1, 9)}


def test_latest_by_batches(spark, tmp_path):
    folder, out, progress = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "progress")
    add(spark, folder, [("a", 1, 0), ("a", 2, 9), ("b", 3, 1)])
    ingest.drain_latest(ingest.stream_of(spark, folder), "key", ["ts", "n"], out, progress)
    add(spark, folder, [("b", 9, 3), ("a", 7, 4)])
    ingest.drain_latest(ingest.stream_of(spark, folder), "key", ["ts", "n"], out, progress)
    got = latest(spark.read.parquet(out).drop("batch"), "key", "ts", "n")
    assert {r.key: r.n for r in got.select("key", F.col("n")).collect()} == {"a": 2, "b": 9}
