"""Streaming monitors over arriving frames or signals: an extension, as the reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drift_windows(events: DataFrame, limit: float = 60.0, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, bad, total): off values per window and type. Works on batches and, with a watermark, on streams."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    counts = timed.groupBy(F.window("at", length).alias("w"), "event_type").agg(F.count_if(F.col("value") > limit).alias("bad"), F.count(F.lit(1)).alias("total"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "bad", "total")


def read_events(spark, folder: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
