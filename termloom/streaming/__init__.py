"""An extension: pages as a stream. The reference workload itself has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import parse_pages


def parsed_pages(spark: SparkSession, path: str, schema: str = "page_id LONG, url STRING, html STRING", files_per_batch: int = 100) -> DataFrame:
    """Pages of Parquet files, parsed as the files arrive."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return parse_pages(raw)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs write on every batch that there is, then ends; a batch that was written is not written again after a restart."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and time window; rows that come later than `late` are not counted."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
