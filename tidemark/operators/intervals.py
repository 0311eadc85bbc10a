"""Interval flags and range joins.

Range predicates are turned into equi-joins on ``floor(position / bin)`` with the interval side
exploded over the bins it touches, so the engine is free to broadcast a small side (from its own
size estimate) or to sort-merge a large one. No cross joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.index import CHUNK, chunk_of, drop_halo, halo, in_chunk

#: Bin where the spans' length is not known; callers that know it pass ``bin_width``.
BIN = 512


def bin_width(span: int) -> int:
    """Bin for spans of a known length: the next power of two from twice the length, 64 at least.

    A span then touches two bins at most and meets at most four times as many points as it holds.
    """
    return max(64, 1 << (2 * span - 1).bit_length())


def flag_around(
    stream: DataFrame, centres: DataFrame, flags: dict[str, tuple[int, int]], centre: str = "centre", by: str = "idx"
) -> DataFrame:
    """Boolean columns that say whether a sample lies in ``[centre+lo, centre+hi]`` of any event.

    Centres are gathered by the narrow bins that their flags can reach, distinct and so at most a
    few hundred per bin, and one left equi-join on the bin sets all flags. The catalogue may be
    another table of any size; where events are rows of the stream itself, :func:`flag_ordered`
    needs no join and keeps the stream in order.
    """
    lo = min(a for a, _ in flags.values())
    hi = max(b for _, b in flags.values())
    width = bin_width(hi - lo + 1)
    reach = centres.select(F.col(centre).alias("_c")).distinct().select("_c", (F.col("_c") + lo).alias("_lo"), (F.col("_c") + hi).alias("_hi"))
    marks = over_bins(reach, "_lo", "_hi", width).groupBy("_bin").agg(F.collect_set("_c").alias("_centres"))
    near = lambda a, b: F.coalesce(F.exists("_centres", lambda c: (F.col(by) - c).between(a, b)), F.lit(False))
    return (
        stream.withColumn("_bin", chunk_of(by, width))
        .join(marks, "_bin", "left")
        .select(*stream.columns, *[near(a, b).alias(n) for n, (a, b) in flags.items()])
    )


def flag_ordered(
    stream: DataFrame, is_centre: Column, flags: dict[str, tuple[int, int]], chunk: int = CHUNK, by: str = "idx"
) -> DataFrame:
    """As :func:`flag_around`, for centres that are rows of the stream itself; the result is in ``by`` order.

    Chunks with halo rows are dealt out by range, so each partition holds a contiguous run of the
    stream, sorted, and frames answer the flags: one shuffle, no join. Written as it is, the files'
    position ranges do not overlap and position filters skip row groups.
    """
    before, after = max(0, *(b for _, b in flags.values())), max(0, *(-a for a, _ in flags.values()))
    marked = stream.withColumn("_centre", F.coalesce(is_centre, F.lit(False)))
    near = halo(marked, before, after, chunk, by).repartitionByRange("_chunk")
    w = in_chunk(by)
    set_ = {n: F.coalesce(F.max("_centre").over(w.rowsBetween(-b, -a)), F.lit(False)) for n, (a, b) in flags.items()}
    return drop_halo(near.select(*stream.columns, "_own", "_chunk", *[e.alias(n) for n, e in set_.items()]))


def over_bins(intervals: DataFrame, lo: str, hi: str, width: int = BIN) -> DataFrame:
    """One row per bin that the interval touches."""
    return intervals.select(
        "*", F.explode(F.sequence(chunk_of(lo, width), chunk_of(hi, width))).alias("_bin")
    )


def merged_by_bin(intervals: DataFrame, lo: str, hi: str, width: int = BIN) -> DataFrame:
    """Per bin, the disjoint intervals that touch it: ``_bin, spans ARRAY<STRUCT<lo, hi>>``.

    Intervals that begin together are reduced to the longest before they meet, so a bin handles
    at most one interval per position of its width however many events crowd into it, and the
    merged array is shorter still.
    """
    binned = (
        over_bins(intervals.select(F.col(lo).alias("lo"), F.col(hi).alias("hi")), "lo", "hi", width)
        .groupBy("_bin", F.greatest("lo", F.col("_bin") * width).alias("lo"))
        .agg(F.max("hi").alias("hi"))
    )
    w = Window.partitionBy("_bin").orderBy("lo")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = binned.withColumn("_new", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
    spans = opened.withColumn("_g", F.sum("_new").over(w)).groupBy("_bin", "_g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return spans.groupBy("_bin").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def flag_inside(points: DataFrame, merged: DataFrame, point: str, name: str, width: int = BIN) -> DataFrame:
    """One output row per point, flagged if it lies in an interval of :func:`merged_by_bin`."""
    inside = F.exists("spans", lambda s: F.col(point).between(s["lo"], s["hi"]))
    return (
        points.withColumn("_bin", chunk_of(point, width))
        .join(merged, "_bin", "left")
        .select(*points.columns, F.coalesce(inside, F.lit(False)).alias(name))
    )


def interval_join(
    points: DataFrame, intervals: DataFrame, point: str, lo: str, hi: str, how: str = "inner", width: int = BIN
) -> DataFrame:
    """Join each point to the intervals ``[lo, hi]`` that hold it.

    A point lies in exactly one bin, so each pair is met once.
    """
    left = points.withColumn("_bin", chunk_of(point, width))
    right = over_bins(intervals.filter(F.col(lo) <= F.col(hi)), lo, hi, width).withColumnRenamed("_bin", "_rbin")
    on = (F.col("_bin") == F.col("_rbin")) & F.col(point).between(F.col(lo), F.col(hi))
    return left.join(right, on, how).drop("_bin", "_rbin")


def overlap_join(
    left: DataFrame, right: DataFrame, l_lo: str, l_hi: str, r_lo: str, r_hi: str, width: int = BIN
) -> DataFrame:
    """Pairs of intervals that share a position.

    Pairs that meet in several bins are kept only in the bin of the later start.
    """
    a = over_bins(left, l_lo, l_hi, width)
    b = over_bins(right, r_lo, r_hi, width).withColumnRenamed("_bin", "_rbin")
    first = chunk_of(F.greatest(F.col(l_lo), F.col(r_lo)), width)
    on = (
        (F.col("_bin") == F.col("_rbin"))
        & (F.col(l_hi) >= F.col(r_lo))
        & (F.col(l_lo) <= F.col(r_hi))
        & (F.col("_bin") == first)
    )
    return a.join(b, on).drop("_bin", "_rbin")


def containment_join(
    inner: DataFrame, outer: DataFrame, i_lo: str, i_hi: str, o_lo: str, o_hi: str, width: int = BIN
) -> DataFrame:
    """Pairs where the inner interval lies wholly in the outer one."""
    return interval_join(inner, outer, i_lo, o_lo, o_hi, width=width).filter(F.col(i_hi) <= F.col(o_hi))


def neighbourhood(
    stream: DataFrame, anchors: DataFrame, anchor: str, before: int, after: int, by: str = "idx"
) -> DataFrame:
    """Rows of ``[anchor-before, anchor+after]`` of every anchor, with ``rel_pos`` = distance to it."""
    a = F.col(anchor)
    spans = anchors.withColumn("_lo", F.greatest(a - before, F.lit(0).cast("long"))).withColumn("_hi", a + after)
    out = interval_join(stream, spans, by, "_lo", "_hi", width=bin_width(before + after + 1))
    return out.withColumn("rel_pos", F.col(by) - a).drop("_lo", "_hi")


def lookup_by_clock(events: DataFrame, stream: DataFrame, clock: str = "sclk") -> DataFrame:
    """First stream position that carries the event's clock; null position where none does.

    The stream is cut down to the wanted clocks before anything is grouped.
    """
    wanted = events.select(clock).distinct()
    first = stream.select(clock, "idx").join(wanted, clock).groupBy(clock).agg(F.min("idx").alias("idx"))
    return events.join(first, clock, "left")

