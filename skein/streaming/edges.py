"""Counts over a stream of events: an extension, kept by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, value) by tumbling window; rows later than ``late`` are left out of a running stream."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def read_stream(spark: SparkSession, like: str, folder: str) -> DataFrame:
    """A stream over the parquet files that appear in ``folder``, with the columns of the table ``like``."""
    schema = spark.read.parquet(like).schema
    return spark.readStream.schema(schema).parquet(folder)


def run_once(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Write what has arrived to ``out``, exactly once a window, and stop."""
    counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
