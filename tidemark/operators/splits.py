"""Chronological splits by position, and the audits of their isolation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.attach import attach, few

# train, gap, validation shares: the two configurations in use.
SPLIT_70 = (0.70, 0.035, 0.15)
SPLIT_60 = (0.60, 0.005, 0.15)


def row_count(stream: DataFrame) -> DataFrame:
    """One row ``n`` for a dense stream."""
    return stream.agg((F.max("idx") + 1).alias("_n"))


def position_split(
    df: DataFrame, shares=SPLIT_70, keep_gaps: bool = False, by: str = "idx", rows: DataFrame | None = None
) -> DataFrame:
    """Add ``split`` by position; gap rows are dropped (or kept with a null split).

    ``rows`` is the one-row length of the stream, for frames that are not the stream itself.
    """
    train, gap, val = shares
    n, i = F.col("_n"), F.col(by)

    def cut(share: float):
        return F.floor(n * F.lit(share)).cast("long")

    split = (
        F.when(i < cut(train), "train")
        .when((i >= cut(train + gap)) & (i < cut(train + gap + val)), "val")
        .when(i >= cut(train + 2 * gap + val), "test")
    )
    out = attach(df, row_count(df) if rows is None else rows).withColumn("split", split).drop("_n")
    return out if keep_gaps else out.filter(F.col("split").isNotNull())


def chronological_split(stream: DataFrame, train: float, val: float, **kw) -> DataFrame:
    """Split without gaps; ``val`` runs to the end when the shares add up to one."""
    return position_split(stream, (train, 0.0, val), **kw)


def split_bounds(split_stream: DataFrame) -> DataFrame:
    return split_stream.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("idx").alias("first_idx"),
        F.max("idx").alias("last_idx"),
        F.min("sclk").alias("first_sclk"),
        F.max("sclk").alias("last_sclk"),
    )


def events_by_split(events: DataFrame, split_stream: DataFrame, open_ends: bool = False) -> DataFrame:
    """Give each event the split whose clock range holds it.

    ``open_ends`` lets the first split reach back and the last one forward without limit.
    The range side has one row per split.
    """
    b = split_stream.groupBy("split").agg(F.min("sclk").alias("_lo"), F.max("sclk").alias("_hi"))
    if open_ends:
        floor, ceiling = F.lit(-(1 << 62)), F.lit(1 << 62)
        b = b.select(
            "split",
            F.when(F.col("split") == "train", floor).otherwise(F.col("_lo")).alias("_lo"),
            F.when(F.col("split") == "test", ceiling).otherwise(F.col("_hi")).alias("_hi"),
        )
    holds = F.filter("_few", lambda s: F.col("sclk").between(s["_lo"], s["_hi"]))
    return attach(events, few(b)).withColumn("_few", holds).select(*events.columns, F.inline("_few")).drop("_lo", "_hi")


def isolation_report(split_stream: DataFrame) -> DataFrame:
    """Per split: its clock range, the hours since the split before it, and whether they overlap."""
    w = Window.orderBy("first_idx")  # one row per split
    gap = F.col("first_sclk") - F.lag("last_sclk").over(w)
    return split_bounds(split_stream).select(
        "*",
        F.coalesce(gap <= 0, F.lit(False)).alias("overlaps"),
        F.when(gap > 0, gap / 3600.0).otherwise(0.0).alias("gap_hours"),
    )
