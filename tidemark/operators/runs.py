"""Runs of a flag (gaps and islands) and the events built from them.

Runs are found inside chunks from ``idx - row_number()``. Only the pieces that touch a chunk
border (at most two per chunk) go through the second pass that joins them up, so a run may be
longer than any chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.index import CHUNK, chunk_of
from tidemark.operators.intervals import containment_join, interval_join


def run_rows(df: DataFrame, flag: Column, chunk: int = CHUNK, by: str = "idx") -> DataFrame:
    """Flagged rows with ``run_start``, the first position of the run they belong to."""
    w = Window.partitionBy("_chunk").orderBy(by)
    rows = (
        df.filter(flag)
        .withColumn("_chunk", chunk_of(by, chunk))
        .withColumn("_island", F.col(by) - F.row_number().over(w))
    )
    piece = Window.partitionBy("_chunk", "_island")
    rows = rows.withColumn("_piece", F.min(by).over(piece)).drop("_island")
    pieces = rows.groupBy("_chunk", "_piece").agg(F.max(by).alias("_end"))
    return rows.join(_stitch(pieces, chunk), ["_chunk", "_piece"], "left").select(
        *df.columns, F.coalesce("_start", "_piece").alias("run_start")
    )


def _stitch(pieces: DataFrame, chunk: int) -> DataFrame:
    """``_chunk, _piece → _start`` for pieces that touch a chunk border."""
    lo = F.col("_chunk") * chunk
    border = pieces.filter((F.col("_piece") == lo) | (F.col("_end") == lo + chunk - 1))
    w = Window.orderBy("_piece")
    opens = F.coalesce(F.lag("_end").over(w) + 1 < F.col("_piece"), F.lit(True))
    starts = border.withColumn("_open", F.when(opens, F.col("_piece")))
    filled = F.last("_open", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return starts.select("_chunk", "_piece", filled.alias("_start"))


def runs(df: DataFrame, flag: Column, chunk: int = CHUNK, by: str = "idx", clock: str | None = None) -> DataFrame:
    """Maximal runs as ``start_idx, end_idx`` (inclusive) and, with ``clock``, their clock bounds.

    A run still open at the end of the stream is closed at its last row.
    """
    w = Window.partitionBy("_chunk").orderBy(by)
    extra = [F.min(clock).alias("start_sclk"), F.max(clock).alias("end_sclk")] if clock else []
    pieces = (
        df.filter(flag)
        .select(by, *([clock] if clock else []), chunk_of(by, chunk).alias("_chunk"))
        .withColumn("_island", F.col(by) - F.row_number().over(w))
        .groupBy("_chunk", "_island")
        .agg(F.min(by).alias("_piece"), F.max(by).alias("_end"), *extra)
    )
    whole = pieces.join(_stitch(pieces, chunk), ["_chunk", "_piece"], "left").groupBy(
        F.coalesce("_start", "_piece").alias("start_idx")
    )
    again = [F.min("start_sclk").alias("start_sclk"), F.max("end_sclk").alias("end_sclk")] if clock else []
    return whole.agg(F.max("_end").alias("end_idx"), *again)


def clock_runs(df: DataFrame, flag: Column, chunk: int = CHUNK) -> DataFrame:
    """Runs in clock units: they end one second before the next row; an open run ends at its last clock."""
    spans = runs(df, flag, chunk, clock="sclk").withColumn("_next", F.col("end_idx") + 1)
    nxt = df.select(F.col("idx").alias("_next"), F.col("sclk").alias("_next_sclk"))
    return (
        spans.join(nxt, "_next", "left")
        .withColumn("end_sclk", F.coalesce(F.col("_next_sclk") - 1, F.col("end_sclk")))
        .drop("_next", "_next_sclk")
    )


def nested_events(stream: DataFrame, chunk: int = CHUNK, reach: int = 200) -> DataFrame:
    """Events as nested intervals: wide run ⊃ event rows, with the precursor run before them.

    The precursor is looked for in the ``reach`` samples before the event rows, inside the wide
    run but not on its first sample; its own start is followed back under the same rule. The peak
    is the first lowest pressure of the event rows. Wide runs without event rows are dropped; a
    run still open at the end of the stream is kept.
    """
    wide = runs(stream, F.col("gt_4xfwhm"), chunk).select(
        F.col("start_idx").alias("fourxfwhm_start"), F.col("end_idx").alias("fourxfwhm_end")
    )
    core_rows = stream.filter("gt_fwhm").select("idx", "sclk", "pressure")
    core = (
        interval_join(core_rows, wide, "idx", "fourxfwhm_start", "fourxfwhm_end")
        .groupBy("fourxfwhm_start", "fourxfwhm_end")
        .agg(
            F.min("idx").alias("fwhm_start"),
            F.max("idx").alias("fwhm_end"),
            F.min(F.struct("pressure", "idx", "sclk")).alias("_peak"),
        )
    )
    # Backward scan from fwhm_start-1 that stops before max(fourxfwhm_start, fwhm_start-reach).
    limit = F.greatest(F.col("fourxfwhm_start"), F.col("fwhm_start") - reach)
    core = core.withColumn("_lo", limit + 1).withColumn("_hi", F.col("fwhm_start") - 1)
    det_runs = runs(stream, F.col("gt_detection_win"), chunk)
    det_rows = interval_join(
        stream.filter("gt_detection_win").select("idx"),
        core.select("fourxfwhm_start", "_lo", "_hi"),
        "idx",
        "_lo",
        "_hi",
    )
    last_det = det_rows.groupBy("fourxfwhm_start").agg(F.max("idx").alias("detection_end"))
    found = interval_join(last_det, det_runs, "detection_end", "start_idx", "end_idx").select(
        "fourxfwhm_start", "detection_end", "start_idx"
    )
    out = core.join(found, "fourxfwhm_start", "left")
    floor = F.greatest(F.col("fourxfwhm_start"), F.col("detection_end") - reach) + 1
    return out.select(
        F.col("_peak.sclk").alias("peak_sclk"),
        F.col("_peak.idx").alias("peak_idx"),
        F.when(F.col("detection_end").isNotNull() & (floor <= F.col("detection_end")), F.greatest("start_idx", floor)).alias(
            "detection_start"
        ),
        "detection_end",
        "fwhm_start",
        "fwhm_end",
        "fourxfwhm_start",
        "fourxfwhm_end",
        (F.col("_peak.idx") / 3600.0).alias("time_hours"),
    )


def state_events(stream: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs of precursor-or-event rows, with how many rows of each kind they hold."""
    rows = run_rows(stream, F.col("gt_fwhm") | F.col("gt_detection_win"), chunk)
    precursor = F.col("gt_detection_win") & ~F.col("gt_fwhm")
    return rows.groupBy(F.col("run_start").alias("start_idx")).agg(
        F.max("idx").alias("end_idx"),
        F.min("sclk").alias("start_sclk"),
        F.max("sclk").alias("end_sclk"),
        F.sum(F.col("gt_fwhm").cast("long")).alias("fwhm_rows"),
        F.sum(precursor.cast("long")).alias("detection_rows"),
    )


def complete_events(stream: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Events that open on a precursor and do reach the event rows."""
    return state_events(stream, chunk).filter((F.col("fwhm_rows") > 0) & (F.col("detection_rows") > 0))


def windows_in_events(windows: DataFrame, events: DataFrame) -> DataFrame:
    """Windows that lie wholly inside an event's span."""
    return containment_join(windows, events, "start_idx", "end_idx", "span_start", "span_end")
