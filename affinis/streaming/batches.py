"""Bounded-memory processing of tables that grow: an extension over Structured Streaming; the batch operators need none of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def in_batches(spark: SparkSession, path: str, schema, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 16) -> None:
    """Applies work to `files` new files at a time, each batch written once, and returns when none is left; a later call goes on from there."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    write = lambda batch, n: work(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")
