"""Cutting the stream into windows, and labelling them."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.operators.index import CHUNK, centred, chunk_of, halo, in_chunk, renumber, rolling, trailing
from tidemark.operators.intervals import bin_width, interval_join

TRUE, FALSE, OMIT = "True", "False", "Omit"


def right_edge_label(detection: Column, fwhm: Column) -> Column:
    """Label of a window from its last sample: precursor, else inside the event, else quiet."""
    return F.when(detection, TRUE).when(fwhm, OMIT).otherwise(FALSE)


def window_ends(stream: DataFrame, size: int = 60, step: int = 10) -> DataFrame:
    """One row per full window, carrying the columns of its last sample.

    Right-edge labels and scores need only that sample, so this is a filter and not a shuffle.
    """
    start = F.col("idx") - (size - 1)
    return stream.filter((start >= 0) & (start % step == 0)).select(
        (start / step).cast("long").alias("window_id"), start.alias("start_idx"), F.col("idx").alias("end_idx"), "*"
    )


def explode_windows(stream: DataFrame, size: int, step: int, first: int = 0) -> DataFrame:
    """Long form: each sample once per full window that holds it, with ``window_id`` and ``pos``.

    Copies every sample ``size/step`` times; features over sliding windows use panes instead.
    """
    i = F.col("idx") - first
    lowest = F.greatest(F.ceil((i - (size - 1)) / step), F.lit(0)).cast("long")
    highest = F.floor(i / step).cast("long")
    ids = F.when(lowest <= highest, F.sequence(lowest, highest))  # none between windows that are apart
    last = stream.agg((F.floor((F.max("idx") - first + 1 - size) / step)).cast("long").alias("_last"))
    return (
        attach(stream.filter(i >= 0).select("*", F.explode(ids).alias("window_id")), last)
        .filter(F.col("window_id") <= F.col("_last"))
        .drop("_last")
        .withColumn("pos", F.col("idx") - first - F.col("window_id") * step)
    )


def numbered_survivors(windows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Drop windows marked Omit and number the rest afresh in stream order."""
    return renumber(windows.filter(F.col("label") != OMIT), "sliding_window_id", by="end_idx", chunk=chunk)


def any_label(stream: DataFrame, flag: Column, size: int, chunk: int = CHUNK) -> DataFrame:
    """Step-1 windows by end row: 1 if any sample of the trailing window is flagged."""
    hit = F.max(flag.cast("int")).over(trailing(size))
    return rolling(stream, {"window_label": hit}, size - 1, chunk=chunk).filter(F.col("idx") >= size - 1)


def next_sample_label(stream: DataFrame, flag: Column, size: int, chunk: int = CHUNK) -> DataFrame:
    """Step-1 windows by end row, labelled by the sample right after the window."""
    after = F.lead(flag.cast("int"), 1).over(in_chunk())
    out = rolling(stream, {"window_label": after}, 0, 1, chunk=chunk)
    return out.filter((F.col("idx") >= size - 1) & F.col("window_label").isNotNull())


def lookahead_label(
    stream: DataFrame, flag: Column, size: int, horizon: int = 10, anchor: str = "start", chunk: int = CHUNK
) -> DataFrame:
    """1 if any of ``horizon`` samples is flagged, counted from the window's start or from after its end."""
    if anchor == "start":
        frame, reach = in_chunk().rowsBetween(0, horizon - 1), horizon - 1
    else:
        frame, reach = in_chunk().rowsBetween(size, size + horizon - 1), size + horizon - 1
    whole = F.count(F.lit(1)).over(in_chunk().rowsBetween(0, size - 1))
    out = rolling(
        stream, {"window_label": F.max(flag.cast("int")).over(frame), "_whole": whole}, 0, max(reach, size - 1), chunk
    )
    return (
        out.filter(F.col("_whole") == size)
        .withColumnRenamed("idx", "start_idx")
        .withColumn("window_label", F.coalesce("window_label", F.lit(0)))
        .drop("_whole")
    )


def windows_from(stream: DataFrame, starts: DataFrame, size: int, start: str = "start_idx") -> DataFrame:
    """Long form of the windows ``[start, start+size-1]`` listed in ``starts``, with ``pos``."""
    spans = starts.withColumn("_hi", F.col(start) + size - 1)
    return interval_join(stream, spans, "idx", start, "_hi", width=bin_width(size)).withColumn("pos", F.col("idx") - F.col(start)).drop("_hi")


def tumbling(stream: DataFrame, size: int = 60) -> DataFrame:
    """Blocks of ``size`` rows; the last one may be short."""
    return stream.withColumn("window_id", chunk_of("idx", size)).withColumn("pos", F.col("idx") % size)


def window_arrays(stream: DataFrame, size: int, step: int, value: str = "pressure", chunk: int = CHUNK) -> DataFrame:
    """``end_idx`` and ``samples ARRAY`` of every full window ``[k*step, k*step+size-1]``.

    Samples are gathered once per pane of ``gcd(size, step)`` rows; a window is the concatenation
    of its panes, so no sample is shuffled more than once and no array outgrows ``size``. Windows
    with a null reading are dropped.
    """
    width = gcd(size, step)
    panes_in = size // width
    panes = stream.groupBy(chunk_of("idx", width).alias("pane")).agg(
        F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v")))).alias("_rows")
    )
    panes = panes.select("pane", F.transform("_rows", lambda r: r["v"]).alias("_a"))
    pane_chunk = max(panes_in, chunk // width)
    near = halo(panes, 0, panes_in - 1, pane_chunk, by="pane")
    w = in_chunk("pane")
    # concat is null as soon as one pane is missing at the end of the stream.
    joined = F.concat(*[F.lead("_a", k).over(w) if k else F.col("_a") for k in range(panes_in)])
    out = near.select("pane", "_own", joined.alias("samples")).filter(
        F.col("_own") & (F.col("pane") % (step // width) == 0) & (F.size("samples") == size)
        & ~F.exists("samples", lambda v: v.isNull())
    )
    return out.select((F.col("pane") * width + size - 1).alias("end_idx"), "samples")


def pad_last(samples: Column, size: int) -> Column:
    """Extend a short window with copies of its last value."""
    missing = F.greatest(F.lit(size) - F.size(samples), F.lit(0))
    return F.concat(samples, F.array_repeat(F.element_at(samples, -1), missing))


def nested_windows(long_rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long form → one row per window with ``window_data ARRAY<STRUCT>`` ordered by position."""
    record = F.struct("pos", *fields)
    return long_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(record)).alias("window_data"))


def opened_windows(nested: DataFrame, json_col: str, fields: str) -> DataFrame:
    """The reverse of writing :func:`nested_windows` as JSON: one row per record, with the other columns."""
    keys = [c for c in nested.columns if c != json_col]
    return nested.select(*keys, F.inline(F.from_json(json_col, f"array<struct<{fields.replace(' ', ':')}>>".replace(",:", ","))))


def context_windows(stream: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Rows of ``[anchor-before, anchor+after)`` for anchors whose whole context exists."""
    last = stream.agg(F.max("idx").alias("_last"))
    whole = (
        attach(anchors, last)
        .filter((F.col("anchor") >= before) & (F.col("anchor") + after - 1 <= F.col("_last")))
        .select("*", (F.col("anchor") - before).alias("_lo"), (F.col("anchor") + after - 1).alias("_hi"))
        .drop("_last")
    )
    return (
        interval_join(stream, whole, "idx", "_lo", "_hi", width=bin_width(before + after))
        .withColumn("rel_pos", F.col("idx") - F.col("anchor"))
        .drop("_lo", "_hi")
    )


def savgol_weights(length: int) -> list[float]:
    """Centre weights of the quadratic least-squares smoother of odd ``length``."""
    m = length // 2
    s0 = float(length)
    s2 = float(sum(k * k for k in range(-m, m + 1)))
    s4 = float(sum(k**4 for k in range(-m, m + 1)))
    det = s0 * s4 - s2 * s2
    return [(s4 - s2 * k * k) / det for k in range(-m, m + 1)]


def centred_slope(value: str, length: int) -> Column:
    """OLS slope over the centred frame, shrinking at the edges; 0 where it has under two points."""
    return F.coalesce(F.regr_slope(F.col(value), F.col("idx").cast("double")).over(centred(length // 2)), F.lit(0.0))
