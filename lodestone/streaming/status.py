"""Engine extension: repository status and activity from an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def activity(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Events and values by window and type; works on a table and, with its watermark, on a stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")
