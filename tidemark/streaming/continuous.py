"""Streaming operators that built-in streaming functions already express."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.intervals import flag_inside, merged_by_bin


def unique_clocks(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First reading per channel and clock; repeats inside the watermark and late readings are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["channel", "sclk"])


def interval_counts(stream: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Readings, nulls and pressure range per tumbling or sliding interval."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        stream.withWatermark("ts", delay)
        .groupBy(w)
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("pressure").isNull().cast("long")).alias("nulls"),
            F.min("pressure").alias("min_pressure"), F.max("pressure").alias("max_pressure"),
        )
        .select(F.unix_seconds(F.col("window.start")).alias("start_sclk"), "n", "nulls", "min_pressure", "max_pressure")
    )


def gap_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Unbroken stretches per channel: a new one starts after ``gap`` without readings."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy("channel", F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("n"), F.min("sclk").alias("first_sclk"), F.max("sclk").alias("last_sclk"))
        .select("channel", "first_sclk", "last_sclk", "n")
    )


def clock_intervals(centres: DataFrame, before: int, after: int, width: int = 3600) -> DataFrame:
    """Static side of the interval join: merged clock intervals ``[centre-before, centre+after]`` per bin."""
    c = F.col("sclk")
    return merged_by_bin(centres.select((c - before).alias("lo"), (c + after).alias("hi")), "lo", "hi", width)


def flag_intervals(stream: DataFrame, intervals: DataFrame, name: str = "in_event", width: int = 3600) -> DataFrame:
    """Stream–static join: one output row per reading, flagged if its clock lies in an interval."""
    return flag_inside(stream, intervals, "sclk", name, width)
