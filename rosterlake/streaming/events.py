"""Windowed counts and sessions; the same code serves batch frames and streams (give streams a watermark first)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, length: str) -> DataFrame:
    w = F.window("ts", length)
    return events.filter("ts is not null").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding_counts(events: DataFrame, length: str, step: str) -> DataFrame:
    w = F.window("ts", length, step)
    return events.filter("ts is not null").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_windows(events: DataFrame, gap: str) -> DataFrame:
    """Sessions of each user, ended by a pause of ``gap``."""
    rows = events.filter("ts is not null and user_id is not null")
    s = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Rows delivered again within the delay are dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
