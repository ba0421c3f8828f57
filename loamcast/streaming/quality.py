"""Quality counts over event streams, by window and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows, missing values and mean value of each window; batch or stream."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    source = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = source.groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(F.col("value").isNull().cast("int")).alias("missing"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "missing", "mean")
