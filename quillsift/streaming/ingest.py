"""Structured Streaming: the generation cache and event counts as unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.sources import storage


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a folder, or of one file, with the schema they have now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if storage.is_file(spark, path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def first_entries(entries: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once, as long as repetitions come within the watermark."""
    return entries.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, width: str, by: list[str], late: str, value: str | None = None) -> DataFrame:
    """Counts (and sums) by time window and group; rows later than the watermark are left out."""
    measures = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    grouped = timed.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*measures)
    return grouped.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *by, *[m for m in grouped.columns if m not in ("window", *by)])


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and stops; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_latest(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str) -> None:
    """Appends every batch's latest entry of each key; read the table with `cache.latest`."""
    from quillsift.operators.cache import latest

    def store(batch: DataFrame, number: int) -> None:
        latest(batch, key, *order).withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends every group that a batch has changed, with the number of the batch; read the table with `current`.

    Groups behind the watermark leave the state, and no batch rewrites the table.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)

    stream.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(updates: DataFrame, *keys: str) -> DataFrame:
    """The last state of every group of a table of updates."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s")).select(*keys, "_s.*")
