"""Extension: count matrices per time window from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", cell: str = "user_id", feature: str = "event_type", time: str = "ts") -> DataFrame:
    """(window_start, cell, feature, value): events counted per window; works on streams (watermarked) and tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), F.col(cell).alias("cell"), F.col(feature).alias("feature")).agg(F.count("*").alias("value")).select(F.col("w.start").alias("window_start"), "cell", "feature", "value")
