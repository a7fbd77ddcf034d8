"""The intake behaviours on streams. The watermark is ours: two hours, as the inactivity that closes a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "2 hours"


def accept_first(events: DataFrame, dedup_key: list[str], at: str = "at") -> DataFrame:
    """One event per key among those within the watermark of each other."""
    return events.withWatermark(at, LATENESS).dropDuplicatesWithinWatermark(dedup_key)


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """(session, started_at, closed_at, n), emitted once the watermark passes a session's end."""
    counted = events.withWatermark("at", LATENESS).groupBy("session", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("session", F.col("w.start").alias("started_at"), F.col("w.end").alias("closed_at"), "n")


def overflow_per_minute(events: DataFrame) -> DataFrame:
    """(minute, outcome, n) in tumbling windows."""
    counted = events.withWatermark("at", LATENESS).groupBy(F.window("at", "1 minute").alias("w"), "outcome").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("minute"), "outcome", "n")
