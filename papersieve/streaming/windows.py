"""Counters over event streams. Each works on a batch too, with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papersieve.functions.text import case_map
from papersieve.operators.ordered import running_before
from papersieve.operators.scoring import worst_verdict

DEPTH_OF_EVENT = (
    ("queued", 1), ("completed", -1), ("failed", -1), ("quarantined", -1),
)


def day_counters(scans: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Scans and malicious ones per sliding 24 h window, every hour.

    Rows later than ``delay`` are dropped by the watermark when streaming.
    """
    return (
        scans.withWatermark("ts", delay)
        .groupBy(F.window("ts", "24 hours", "1 hour").alias("w"))
        .agg(
            F.count("*").alias("scanned"),
            F.count_if(F.col("verdict") == "malicious").alias("malicious"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "scanned", "malicious")
    )


def daily_tokens(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Positive tokens per UTC day."""
    return (
        calls.where(F.col("tokens") > 0)
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.sum("tokens").alias("tokens"))
        .select(F.to_date("w.start").alias("day"), "tokens")
    )


def depth_delta():
    return F.coalesce(case_map(F.col("kind"), DEPTH_OF_EVENT), F.lit(0))


def queue_depth(events: DataFrame) -> DataFrame:
    """Current depth: queued or active and not yet finished (update mode)."""
    return events.agg(F.sum(depth_delta()).alias("depth")).withColumn(
        "idle", F.col("depth") <= 0
    )


def depth_over_time(events: DataFrame) -> DataFrame:
    """Depth after every event; the running sum is computed in slices."""
    delta = depth_delta().cast("long")
    before = running_before(events, delta, ["ts", "event_id"], (), "_before")
    return before.withColumn("depth", F.col("_before") + delta).withColumn(
        "idle", F.col("depth") <= 0
    ).drop("_before")


def run_verdict(decisions: DataFrame) -> DataFrame:
    """Worst verdict of a run so far (complete mode)."""
    return decisions.agg(worst_verdict(F.col("verdict")).alias("worst"))
