"""Optional streaming form of the event counts (the batch contract is the main one)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type and window; on a stream, late rows beyond the watermark are left out."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return counts.select(F.col("window.start").alias("window_start"), "event_type", "events", "value")


def stream_counts(spark: SparkSession, path: str, schema, checkpoint: str, out: str):
    """Starts the streaming count over Parquet files arriving in ``path``."""
    rows = spark.readStream.schema(schema).parquet(path)
    return windowed_counts(rows).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()
