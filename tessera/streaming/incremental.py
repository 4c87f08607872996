"""Incremental statistics: batches of an unbounded table update a stored, mergeable state.

Each batch writes its partial state under its own number, so a batch that is
retried after a failure replaces what it wrote before; the merged statistics are
a read of all states.  A state has one row for each key and batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import merge_stats, partial_stats


def run_stats(spark: SparkSession, source: str, schema, value: str, by: list[str], state: str, checkpoint: str, files_per_batch: int = 1) -> None:
    """Reads what is new in a Parquet folder, batch by batch, and stores partial statistics; returns when all is read."""

    def store(batch: DataFrame, number: int) -> None:
        partial_stats(batch, value, by).write.mode("overwrite").parquet(f"{state}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stats(spark: SparkSession, state: str, by: list[str]) -> DataFrame:
    """(by..., n, mean, std) of everything read so far."""
    return merge_stats(spark.read.option("basePath", state).parquet(state), by)


def pending(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that haven't been finished."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def mark_done(items: DataFrame, key: str, path: str) -> None:
    """Appends finished keys, after their outputs are written; a repeated mark does no harm."""
    items.select(key).write.mode("append").parquet(path)


def windowed(stream: DataFrame, ts: str, value: str, every: str, late: str) -> DataFrame:
    """Counts and means by event-time window, closed once ``late`` has passed."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), "n", "mean")
