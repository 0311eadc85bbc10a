"""Scoring at the level of events and of points inside events.

Runs are contiguous, so an event is described by its bounds and its first trigger; counts of
points before and after the trigger follow from positions without a second pass over the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions.scalars import ratio
from tidemark.operators.index import CHUNK, exact_percentiles
from tidemark.operators.intervals import interval_join, overlap_join
from tidemark.operators.metrics import confusion, sweep, with_rates
from tidemark.operators.runs import run_rows, runs

def in_event() -> Column:
    return F.col("gt_fwhm") | F.col("gt_detection_win")


def prf(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "*",
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("tp") + c("fn")).alias("recall"),
        ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
    )


def event_triggers(stream: DataFrame, trigger: Column, chunk: int = CHUNK) -> DataFrame:
    """Events with bounds and the first row that satisfies ``trigger`` (null if none)."""
    rows = run_rows(stream, in_event(), chunk)
    return rows.groupBy(F.col("run_start").alias("start_idx")).agg(
        F.max("idx").alias("end_idx"), F.min(F.when(trigger, F.col("idx"))).alias("trigger_idx")
    )


def latch_counts(stream: DataFrame, trigger: Column, outside_hit: Column, chunk: int = CHUNK) -> DataFrame:
    """Point counts where an event's points are hits from its first trigger to its end."""
    length = F.col("end_idx") - F.col("start_idx") + 1
    after = F.coalesce(F.col("end_idx") - F.col("trigger_idx") + 1, F.lit(0).cast("long"))
    zero = F.lit(0).cast("long")
    inside = event_triggers(stream, trigger, chunk).agg(
        F.coalesce(F.sum(after), zero).alias("tp"), F.coalesce(F.sum(length - after), zero).alias("fn")
    )
    outside = stream.filter(~in_event()).agg(
        F.coalesce(F.sum(outside_hit.cast("long")), zero).alias("fp"),
        F.coalesce(F.sum((~outside_hit).cast("long")), zero).alias("tn"),
    )
    return prf(attach(inside, outside))


def latch_on(stream: DataFrame, hit: Column, chunk: int = CHUNK) -> DataFrame:
    """A hit in the precursor turns every later point of the event into a hit."""
    return latch_counts(stream, hit & F.col("gt_detection_win"), hit, chunk)


def triggered_points(stream: DataFrame, predictions: DataFrame, size: int = 60, chunk: int = CHUNK) -> DataFrame:
    """Latch scoring where prediction ``i`` speaks for sample ``i + size - 1`` and any event row triggers."""
    aligned = predictions.select((F.col("i") + size - 1).alias("idx"), F.col("pred").alias("_pred"))
    rows = stream.join(aligned, "idx", "left").withColumn("_hit", F.coalesce(F.col("_pred") == 1, F.lit(False)))
    return latch_counts(rows, F.col("_hit"), F.col("_hit"), chunk)


def event_counts(stream: DataFrame, points: DataFrame, point: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """Events hit by any positive point; each positive point outside every event is one false alarm."""
    events = runs(stream, in_event(), chunk)
    joined = interval_join(points.select(F.col(point).alias("_p")), events, "_p", "start_idx", "end_idx", "left")
    hit = joined.filter(F.col("start_idx").isNotNull()).select("start_idx").distinct().agg(F.count(F.lit(1)).alias("tp"))
    false = joined.filter(F.col("start_idx").isNull()).agg(F.count(F.lit(1)).alias("fp"))
    total = events.agg(F.count(F.lit(1)).alias("events"))
    out = attach(hit, false, total)
    return prf(out.withColumn("fn", F.col("events") - F.col("tp")))


def overlap_counts(
    stream: DataFrame, predicted: DataFrame, size: int = 60, chunk: int = CHUNK, lo: str = "start_idx", hi: str = "end_idx"
) -> DataFrame:
    """Runs of predictions, begun ``size`` earlier, against event runs."""
    true = runs(stream, in_event(), chunk).select(F.col("start_idx").alias("t_lo"), F.col("end_idx").alias("t_hi"))
    pred = predicted.select(
        F.col(lo).alias("p_id"), F.greatest(F.col(lo) - size, F.lit(0)).alias("p_lo"), F.col(hi).alias("p_hi")
    )
    pairs = overlap_join(pred, true, "p_lo", "p_hi", "t_lo", "t_hi")
    hit = pairs.select("t_lo").distinct().agg(F.count(F.lit(1)).alias("tp"))
    used = pairs.select("p_id").distinct().agg(F.count(F.lit(1)).alias("_used"))
    n_true = true.agg(F.count(F.lit(1)).alias("events"))
    n_pred = pred.agg(F.count(F.lit(1)).alias("_pred"))
    out = attach(hit, used, n_true, n_pred)
    return prf(
        out.select("tp", (F.col("_pred") - F.col("_used")).alias("fp"), (F.col("events") - F.col("tp")).alias("fn"), "events")
    )


def lead_times(stream: DataFrame, hit: Column, chunk: int = CHUNK) -> DataFrame:
    """Samples from event start to the first precursor hit: mean, median, min, max, deviation."""
    t = event_triggers(stream, hit & F.col("gt_detection_win"), chunk)
    t = t.filter(F.col("trigger_idx").isNotNull()).select((F.col("trigger_idx") - F.col("start_idx")).alias("lead"))
    stats = t.agg(
        F.count("lead").alias("events"),
        F.coalesce(F.avg("lead"), F.lit(0.0)).alias("mean_lead"),
        F.coalesce(F.min("lead"), F.lit(0)).alias("min_lead"),
        F.coalesce(F.max("lead"), F.lit(0)).alias("max_lead"),
        F.coalesce(F.stddev_pop("lead"), F.lit(0.0)).alias("std_lead"),
    )
    median = exact_percentiles(t, "lead", [0.5]).agg(F.coalesce(F.max("lead"), F.lit(0.0)).alias("median_lead"))
    return attach(stats, median)


def group_validation(rows: DataFrame, group: str, label: Column, hit: Column) -> DataFrame:
    """An event counts as positive, and as found, if any of its windows does."""
    g = rows.groupBy(group).agg(F.bool_or(label).cast("int").alias("y"), F.bool_or(hit).alias("_hit"))
    return with_rates(confusion(g, F.col("_hit")))


def confidence_sweep(stream: DataFrame, points: DataFrame, grid: list[float], chunk: int = CHUNK) -> DataFrame:
    """How many hits inside and outside events reach each threshold, with their ratio."""
    events = runs(stream, in_event(), chunk)
    joined = interval_join(points.select("idx", "p"), events, "idx", "start_idx", "end_idx", "left")
    kinds = joined.select("p", F.col("start_idx").isNotNull().cast("int").alias("y"))
    s = sweep(kinds, grid)
    return s.select(
        "threshold", F.col("tp").alias("hits"), F.col("fp").alias("misses"), ratio(F.col("tp"), F.col("fp")).alias("hit_ratio")
    )
