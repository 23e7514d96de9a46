"""Event load per window with late data cut by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_load(
    events: DataFrame,
    length: str,
    slide: str | None = None,
    delay: str = "1 hour",
    kind: str = "event_type",
) -> DataFrame:
    """Events, distinct kinds apart, per tumbling or sliding window of `ts`.

    A window is written once, when the watermark passes its end.
    """
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        events.withWatermark("ts", delay)
        .groupBy(span.alias("span"), kind)
        .agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("load"))
        .select(F.col("span.start").alias("starts"), F.col("span.end").alias("ends"), kind, "events", "load")
    )


def session_load(events: DataFrame, gap: str, key: str, delay: str = "1 hour") -> DataFrame:
    """Events per session of each `key`: rows no further apart than `gap`."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("span"), key)
        .agg(F.count("*").alias("events"))
        .select(F.col("span.start").alias("starts"), F.col("span.end").alias("ends"), key, "events")
    )
