"""The same operators over streams: pages as they arrive, and event counts with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of a folder's Parquet pages."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def link_stream(pages: DataFrame) -> DataFrame:
    """Links of pages as they arrive; stateless, so any output mode that appends fits."""
    return extract.links(pages)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and window; rows later than the watermark are dropped and state stays bounded."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run to the end of what is there, each batch handed to ``write`` with its number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
