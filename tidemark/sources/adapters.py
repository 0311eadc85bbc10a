"""Bring tables of other shapes into the canonical observation stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.index import dense_index


def epoch_seconds(df: DataFrame, column: str) -> Column:
    """Whole seconds since the epoch, whatever the session time zone is."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.expr(f"floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column}) / 1000000)")
    return F.unix_seconds(F.col(column))


def events_as_stream(events: DataFrame) -> DataFrame:
    """Event log → stream: dense ``idx`` by (ts, event_id), clock in seconds, value as pressure."""
    ordered = dense_index(events.select("event_id", "ts", "user_id", "event_type", "value"), "ts", "event_id")
    sclk = epoch_seconds(ordered, "ts").cast("long")
    hits = F.when(F.col("event_type") != "view", (F.floor("value") % 61).cast("double"))
    return ordered.select(
        "idx",
        "event_id",
        F.col("user_id").alias("channel"),
        "event_type",
        sclk.alias("sclk"),
        F.floor(sclk / 86400).cast("long").alias("sol"),
        F.col("value").alias("pressure"),
        hits.alias("autoencoder_window_hits"),
        F.when(hits.isNotNull(), (hits >= 30).cast("int")).alias("autoencoder_positive_hit"),
        (F.col("value") / (F.col("value") + 50.0)).alias("p"),
    )


def is_event(kind: str = "error", floor: float = 200.0) -> Column:
    """Whether a stream row stands for a labelled event."""
    return (F.col("event_type") == kind) & (F.col("pressure") >= floor)


def catalogue_from_stream(stream: DataFrame, kind: str = "error", floor: float = 200.0) -> DataFrame:
    """Rows that stand for labelled events: ``vortex, sclk, centre``."""
    return stream.filter(is_event(kind, floor)).select(F.col("event_id").alias("vortex"), "sclk", F.col("idx").alias("centre"))
