"""Incremental maintenance over streams of content digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, *, key: str, digest: str, at: str, late: str = "1 hour") -> DataFrame:
    """Rows whose (key, digest) has not been seen within the watermark: what must be computed again.

    Works on streams and on tables; on a stream, state older than ``late`` is let go.
    """
    if not rows.isStreaming:
        return rows.dropDuplicates([key, digest])
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key, digest])


def windowed_counts(events: DataFrame, *, at: str, kind: str, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start_at, kind, n): events by kind in tumbling windows; on a stream, windows close when the watermark has passed."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start_at"), kind, "n")


def sessions(events: DataFrame, *, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start_at, end_at, n): bursts of events of a key with pauses shorter than ``gap``; ``end_at`` is the last event plus ``gap``."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    grouped = rows.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("session_window.start").alias("start_at"), F.col("session_window.end").alias("end_at"), "n")
