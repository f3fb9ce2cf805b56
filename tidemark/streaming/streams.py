"""Streams: a folder as queue, deduplication across batches, daily windows, guarded and chained processing of items.

Results go to tables in the shared folder, never through the driver. Every sink overwrites its own batch, so a batch that is
repeated after a failure leaves no duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_queue(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet", files_at_once: int = 50) -> DataFrame:
    """A stream over the files of a folder, oldest first, ``files_at_once`` a batch. Files are appended to enqueue."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def enqueue(items: DataFrame, folder: str) -> None:
    """Append items to a queue's folder."""
    items.write.mode("append").parquet(folder)


def deduplicated(stream: DataFrame, keys: list[str], time: str | None = None, horizon: str | None = None) -> DataFrame:
    """The first row of each key. Without a horizon the state keeps every key; with one, those of the horizon only."""
    if horizon is None:
        return stream.dropDuplicates(keys)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def daily_means(stream: DataFrame, key: str, time: str, value: str, lateness: str = "1 day") -> DataFrame:
    """(key, day, mean, n) in tumbling windows of one day."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", lateness)
    grouped = timed.groupBy(F.col(key), F.window("__t", "1 day")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return grouped.select(key, F.to_date("window.start").alias("day"), "mean", "n")


def _put(rows: DataFrame, number: int, path: str) -> None:
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there into a table at ``path`` and return its rows. In the mode ``update`` the last row
    of each of ``keys`` counts, so windows that no watermark has closed yet are there too."""
    spark, schema = stream.sparkSession, stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    writer.foreachBatch(lambda rows, number: _put(rows, number, path)).start().awaitTermination()
    rows = spark.read.schema(schema.add("batch", "long")).parquet(path)
    if mode == "append":
        return rows.drop("batch")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__x")).select(*keys, "__x.*")


def process_queue(stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, quarantine: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Score each batch and append it to ``target``; items whose score is null go to ``quarantine`` and are not lost."""

    def one(batch: DataFrame, number: int) -> None:
        scored = score(batch).persist()
        for rows, path in ((scored.where("score is not null"), target), (scored.where("score is null"), quarantine)):
            _put(rows, number, path)
        scored.unpersist()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def chained(stream: DataFrame, steps: list[tuple[Callable[[DataFrame], DataFrame], str]], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run the steps (function, path) on each batch one after another, each on the stored result of the one before."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for step, path in steps:
            _put(step(batch), number, path)
            batch = spark.read.parquet(path).where(F.col("batch") == number).drop("batch")

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
