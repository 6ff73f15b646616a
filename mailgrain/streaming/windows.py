"""Event-time windows, the same function for batch and stream inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Streams need a time with a zone for their watermark; tables keep theirs, so no session's zone changes a result."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """window_start, event_type, events, total. In a stream, rows later than ``late`` behind the newest drop out."""
    e = _watermarked(events, ts, late)
    return e.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "events", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """user_id, session_start, session_end, events. A session ends ``gap`` after its last event."""
    e = _watermarked(events, ts, late)
    return e.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(
        user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"
    )


def deduplicated(events: DataFrame, key: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """First row of each key; a stream forgets keys after ``late``."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])
