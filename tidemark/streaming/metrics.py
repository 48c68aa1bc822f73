"""Windowed metrics over an event stream ``(event_id, ts, user_id, event_type, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

MONEY = "decimal(18,2)"


def daily_metrics(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Count, sum and approximate users per day and event type."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", "1 day").alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum(F.col("value").cast(MONEY)).alias("total"),
                 F.approx_count_distinct("user_id").alias("approx_users"))
            .select(F.col("w.start").alias("day_start"), "event_type", "n_events", "total",
                    "approx_users"))


def daily_users(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Exact number of distinct users per closed day, by two operators in a row.

    The first keeps a day's users until the watermark has passed the day, the second counts them.
    Both drop their state then; days come out in append mode.
    """
    return (events.withWatermark("ts", delay)
            .select(F.window("ts", "1 day").alias("w"), "user_id")
            .filter("user_id IS NOT NULL").dropDuplicates(["w", "user_id"])
            .groupBy("w").agg(F.count(F.lit(1)).alias("users"))
            .select(F.col("w.start").alias("day_start"), "users"))


def without_repeats(events: DataFrame, ids: list[str], delay: str = "1 hour",
                    time: str = "ts") -> DataFrame:
    """The first delivery of every event; ``ids`` tell events apart.

    An id is held until the watermark, ``delay`` behind the newest ``time`` seen, is ``delay``
    past its first delivery, so the state covers a span of time and not the stream. A repeat with
    a time after that counts as a new event; a row behind the watermark is dropped.
    """
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(ids)


def control_bands(events: DataFrame, span: str = "7 days", slide: str = "1 day",
                  delay: str = "1 hour") -> DataFrame:
    """Mean, spread and two-sigma limits of the value per sliding window and event type."""
    mean, std = F.col("mean"), F.col("std")
    return (events.withWatermark("ts", delay)
            .groupBy(F.window("ts", span, slide).alias("w"), "event_type")
            .agg(F.count("value").alias("n"), F.avg("value").alias("mean"),
                 F.stddev_pop("value").alias("std"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_type", "n", "mean", "std", (mean + 2.0 * std).alias("ucl"),
                    F.greatest(F.lit(0.0), mean - 2.0 * std).alias("lcl")))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Activity sessions per user (extension)."""
    return (events.withWatermark("ts", delay)
            .groupBy(F.session_window("ts", gap).alias("s"), "user_id")
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select("user_id", F.col("s.start").alias("session_start"),
                    F.col("s.end").alias("session_end"), "n_events"))


def counters(events: DataFrame) -> DataFrame:
    """Running totals of a stream: events, value, newest event time."""
    return events.groupBy().agg(
        F.count(F.lit(1)).alias("orders"),
        F.coalesce(F.sum(F.col("value").cast(MONEY)), F.lit(0).cast("decimal(28,2)"))
        .alias("revenue"),
        F.max("ts").alias("last_event_at"))
