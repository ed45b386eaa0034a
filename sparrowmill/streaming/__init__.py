"""Structured Streaming over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowmill.functions import exact, money, utc


def windowed_events(events: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Events and their value per time window and type, for a batch or a stream.

    In append mode a window appears once the watermark has passed its end, so
    the newest windows of a stream are still missing when it stops."""
    timed = events.select(utc("ts").alias("at"), "event_type", "value")
    if events.isStreaming:
        timed = timed.withWatermark("at", lateness)
    return (
        timed.groupBy(F.window("at", width).alias("w"), "event_type")
        .agg(F.count("*").alias("n_events"), money(F.sum(exact("value"))).alias("total_value"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events", "total_value")
    )


def session_windows(events: DataFrame, gap_seconds: int, lateness: str = "1 hour") -> DataFrame:
    """Sessions of each user, split at pauses of more than ``gap_seconds``, for a
    batch or a stream, with the events and their value. Events without a time
    are in no session; those without a user make sessions of their own; equal
    times and repeated rows each count.

    In append mode a session appears once the watermark has passed its last
    event by the gap; until then an event that comes late may extend it or join
    it to another. An event is dropped if the session that it would make alone
    ended before the watermark of the batch before. State holds open sessions alone, so its size
    follows the users of the last gap and lateness, not the stream's length."""
    timed = events.select("user_id", utc("ts").alias("at"), "value")
    if events.isStreaming:
        timed = timed.withWatermark("at", lateness)
    # Spark parts sessions at a pause that equals the gap, so one more microsecond.
    window = F.session_window("at", f"{gap_seconds} seconds 1 microsecond").alias("w")
    return (
        timed.groupBy(window, "user_id")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n_events"), money(F.sum(exact("value"))).alias("total_value"))
        .select("user_id", F.col("first").cast("timestamp_ntz").alias("first_ts"), F.col("last").cast("timestamp_ntz").alias("last_ts"), "n_events", "total_value")
    )
