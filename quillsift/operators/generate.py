"""Generation by a live model, behind the same table as recorded generations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.functions.text import unfence
from quillsift.operators import cache
from quillsift.session import cut_lineage
from quillsift.sources import storage

#: A client is a callable prompt -> text, made once for each partition by a factory without arguments.
Factory = Callable[[], Callable[[str], str]]


def pause(attempt: int) -> float:
    """Seconds to wait after a failed attempt, counted from 0: 2, 4, 6, ... at most 10."""
    return float(min(2 * (attempt + 1), 10))


def ask(client: Callable[[str], str], prompt: str, retries: int = 3, wait: Callable[[float], Any] | None = time.sleep, need_code: bool = False) -> tuple[str, str | None]:
    """(output, error): tries up to max(1, retries) times. With `need_code` a blank answer is a failure too."""
    error = None
    for attempt in range(max(1, retries)):
        try:
            output = client(prompt)
            if not need_code or (output or "").strip():
                return output or "", None
            error = "ValueError: empty answer"
        except Exception as e:  # a failed request becomes a recorded error
            error = f"{type(e).__name__}: {e}"
        if wait:
            wait(pause(attempt))
    return "", error


def generate(requests: DataFrame, key: str, prompt: str, factory: Factory, retries: int = 3, concurrency: int | None = None, backoff: bool = True, need_code: bool = False) -> DataFrame:
    """(key, raw_output, error) for every request, each distinct key asked once.

    `concurrency` sets the number of partitions and so of requests at a time. A task that
    is run again asks again: write the result with `cache.put` before anything reads it.
    """
    todo = requests.select(key, prompt).dropDuplicates([key])
    if concurrency:
        todo = todo.repartition(max(1, concurrency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = factory()
        for batch in batches:
            got = [ask(client, p or "", retries, time.sleep if backoff else None, need_code) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[key, "raw_output", "error"])

    return todo.mapInArrow(run, f"{key} string, raw_output string, error string")


def memoized(requests: DataFrame, key: str, prompt: str, path: str | None, factory: Factory, read: bool = True, write: bool = True, **options: Any) -> DataFrame:
    """Requests with `output`, `code`, `error` and `recorded`: recorded generations first, the model for the rest.

    New generations are appended to the cache at `path` before they are used.
    """
    spark = requests.sparkSession
    have = spark.read.parquet(path) if path and read and storage.exists(spark, path) else spark.createDataFrame([], f"{key} string, raw_output string, error string, at timestamp")
    newest = cache.latest(have.select(key, "raw_output", "error", "at"), key, "at")
    hit: Column = cache.usable("raw_output", "error")
    known = newest.where(hit).select(key, F.lit(True).alias("recorded"))
    requests = requests.join(known, key, "left").withColumn("recorded", F.coalesce("recorded", F.lit(False)))
    requests = cut_lineage(requests) if path and write else requests  # before the cache grows
    made = generate(requests.where("not recorded"), key, prompt, factory, **options).withColumn("at", F.current_timestamp())
    if path and write:
        cache.put(made, path)
        both = cache.latest(spark.read.parquet(path), key, "at")
    else:
        both = newest.where(hit).unionByName(made)
    return cache.replay(requests, both, key).withColumn("code", unfence("output"))
