"""Positive windows, forbidden zones, negative sampling and class balancing."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions.scalars import portable_hash
from tidemark.operators.index import CHUNK, chunk_of, renumber
from tidemark.operators.intervals import flag_inside, merged_by_bin, neighbourhood
from tidemark.operators.runs import runs
from tidemark.session import materialise


def precursor_runs(stream: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return runs(stream, F.col("gt_detection_win"), chunk)


#: Values of the portable hash.
HASHES = 1 << 31
#: What becomes of an event when its window is looked for.
OUTCOMES = ("extracted", "clock_not_found", "no_precursor", "too_short")


def positive_outcomes(
    stream: DataFrame,
    catalogue: DataFrame,
    size: int = 60,
    mode: str = "own_run",
    chunk: int = CHUNK,
    precursors: DataFrame | None = None,
) -> DataFrame:
    """Every event with ``start_idx`` and ``outcome``: the window just before its precursor run, or why there is none.

    ``own_run`` takes the newest precursor run that starts at or before the event;
    ``first_in_split`` takes the first precursor row of the whole stream for every event.
    ``centre`` is the event's place in the stream, null where its clock is not there. ``precursors``
    may hold the precursor runs if they are known already.
    """
    det = precursor_runs(stream, chunk) if precursors is None else precursors
    det = det.select("start_idx")
    known = catalogue.filter(F.col("centre").isNotNull())
    if mode == "first_in_split":
        first = det.agg(F.min("start_idx").alias("_run"))
        found = attach(known, first).withColumn("_run", F.when(F.col("_run") <= F.col("centre"), F.col("_run")))
    else:
        found = newest_at_or_before(known, det, "centre", "start_idx", chunk).withColumnRenamed("start_idx", "_run")
    lost = catalogue.filter(F.col("centre").isNull()).withColumn("_run", F.lit(None).cast("long"))
    origin = stream.agg(F.min("idx").alias("_origin"))
    start = F.col("_run") - size
    outcome = (
        F.when(F.col("centre").isNull(), "clock_not_found")
        .when(F.col("_run").isNull(), "no_precursor")
        .when(start < F.col("_origin"), "too_short")
        .otherwise("extracted")
    )
    out = attach(found.unionByName(lost), origin).withColumn("outcome", outcome)
    return out.withColumn("start_idx", F.when(F.col("outcome") == "extracted", start)).drop("_run", "_origin")


def positive_starts(
    stream: DataFrame,
    catalogue: DataFrame,
    size: int = 60,
    mode: str = "own_run",
    chunk: int = CHUNK,
    precursors: DataFrame | None = None,
    outcomes: Observation | None = None,
) -> DataFrame:
    """Start of the window just before each event's precursor run: ``vortex, centre, start_idx``.

    Events without a precursor, or with too little room before it, are left out (see
    :func:`positive_outcomes`); ``outcomes`` counts them by reason in the pass that makes the windows.
    """
    found = positive_outcomes(stream, catalogue, size, mode, chunk, precursors)
    if outcomes is not None:
        found = found.observe(outcomes, *[F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in OUTCOMES])
    return found.filter(F.col("outcome") == "extracted").drop("outcome")


def newest_at_or_before(left: DataFrame, right: DataFrame, at: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """As-of join backward: newest ``value`` of ``right`` that is ≤ ``left.at`` (null if none).

    Both sides are put on one line and filled forward chunk by chunk.
    """
    line = left.select(F.col(at).alias("_pos"), F.lit(None).cast("long").alias("_val"), F.struct("*").alias("_row"))
    marks = right.select(
        F.col(value).alias("_pos"), F.col(value).cast("long").alias("_val"), F.lit(None).cast(line.schema["_row"].dataType).alias("_row")
    )
    both = line.unionByName(marks).withColumn("_chunk", chunk_of("_pos", chunk))
    # A mark at the same position counts, so marks come first among equals.
    w = Window.partitionBy("_chunk").orderBy("_pos", F.col("_val").isNull())
    frame = w.rowsBetween(Window.unboundedPreceding, 0)
    newest = both.groupBy("_chunk").agg(F.max("_val").alias("_m"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = newest.select("_chunk", F.max("_m").over(before).alias("_in"))
    filled = both.withColumn("_l", F.max("_val").over(frame)).filter(F.col("_row").isNotNull())
    return filled.join(carry, "_chunk").select("_row.*", F.coalesce("_l", "_in").alias(value))


def forbidden_intervals(
    stream: DataFrame,
    positives: DataFrame,
    size: int = 60,
    buffer: int = 50,
    flags: bool = True,
    chunk: int = CHUNK,
    precursors: DataFrame | None = None,
) -> DataFrame:
    """Zones ``[lo, hi]`` where no negative may lie.

    With ``flags`` the precursor runs count and a positive window forbids
    ``[start-buffer, end+buffer)``; without, it forbids ``[start-buffer, start+size+buffer)``.
    """
    reach = size - 1 + buffer - 1 if flags else size + buffer - 1
    zones = positives.select(
        F.greatest(F.col("start_idx") - buffer, F.lit(0).cast("long")).alias("lo"), (F.col("start_idx") + reach).alias("hi")
    ).distinct()
    if flags:
        det = precursor_runs(stream, chunk) if precursors is None else precursors
        zones = zones.unionByName(det.select(F.col("start_idx").alias("lo"), F.col("end_idx").alias("hi")))
    return zones


def free_starts(stream: DataFrame, zones: DataFrame, size: int = 60, tried: Column | None = None) -> DataFrame:
    """Window starts that touch no zone: a start is blocked from ``lo - (size-1)`` to ``hi``.

    ``tried`` is a condition on ``start_idx`` that is put below the join with the zones.
    """
    last = stream.agg((F.max("idx") + 1 - size).alias("_last"))
    low = F.greatest(F.col("lo") - (size - 1), F.lit(0).cast("long"))
    blocked = merged_by_bin(zones.select(low.alias("lo"), "hi"), "lo", "hi")
    starts = attach(stream.select(F.col("idx").alias("start_idx")), last).filter("start_idx <= _last").drop("_last")
    starts = starts if tried is None else starts.filter(tried)
    return flag_inside(starts, blocked, "start_idx", "_blocked").filter("not _blocked").drop("_blocked")


def sample_by_hash(df: DataFrame, key: str, count: int | Column) -> DataFrame:
    """First ``count`` rows in portable-hash order: uniform, exact and repeatable.

    Hash bands below the wanted count are kept whole and only the band that holds the boundary
    matters for ranks, so no task ever sorts or holds the sample as a whole.
    """
    rows = df.withColumn("_h", portable_hash(F.col(key))).withColumn("_band", F.floor(F.col("_h") / (1 << 15)))
    rows = rows.withColumn("_want", count if isinstance(count, Column) else F.lit(count))
    sizes = rows.groupBy("_band").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_band", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_band").orderBy("_h", key))
    # The hash has 31 bits, so there are at most 65,536 bands however long the table is.
    return (
        rows.join(F.broadcast(sizes), "_band")
        .filter(F.col("_before") < F.col("_want"))
        .withColumn("_rank", F.col("_before") + rank)
        .filter(F.col("_rank") <= F.col("_want"))
        .select(*df.columns)
    )


def negative_starts(starts: DataFrame, positives: DataFrame, ratio: float = 1.0, drawn: Observation | None = None) -> DataFrame:
    """``int(positives × ratio)`` window starts without replacement (fewer if there are fewer).

    ``drawn`` notes ``wanted`` and ``drawn`` in the pass that takes them; :func:`shortfall` reads it.
    """
    want = positives.agg(F.floor(F.count(F.lit(1)) * ratio).alias("_k"))
    out = sample_by_hash(attach(starts, want), "start_idx", F.col("_k"))
    if drawn is not None:
        out = out.observe(drawn, F.max("_k").alias("wanted"), F.count(F.lit(1)).alias("drawn"))
    return out.drop("_k")


def drawn_starts(stream: DataFrame, zones: DataFrame, wanted: int, size: int = 60) -> DataFrame:
    """The first ``wanted`` free starts in portable-hash order, without looking at all of them.

    Only starts under a bound of the hash are held against the zones, so many that the wanted ones are
    likely among them; if they are not, the bound is raised eightfold, up to all. What is free under
    the bound is written, and the sample is exact, since it is the beginning of the hash's order.
    """
    n = stream.agg(F.max("idx")).first()[0]
    share = min(1.0, (4 * wanted + 1000) / max(1, n or 1))
    while True:
        below = portable_hash(F.col("start_idx")) < int(share * HASHES)
        free = materialise(free_starts(stream, zones, size, below if share < 1 else None))
        if share >= 1 or free.count() >= wanted:
            return sample_by_hash(free, "start_idx", wanted)
        share = min(1.0, 8 * share)


def shortfall(drawn: Observation) -> int:
    """How many negative windows fewer than wanted were drawn; warns if there are any."""
    got = drawn.get
    lost = (got["wanted"] or 0) - got["drawn"]
    if lost:
        warnings.warn(f"only {got['drawn']} of {got['wanted']} negative windows have room", stacklevel=2)
    return lost


def negative_report(starts: DataFrame, positives: DataFrame, ratio: float = 1.0) -> DataFrame:
    """One row: negative windows wanted, starts available, windows drawn and how many are missing."""
    want = positives.agg(F.floor(F.count(F.lit(1)) * ratio).cast("long").alias("wanted"))
    both = attach(starts.agg(F.count(F.lit(1)).alias("available")), want)
    drawn = F.least("wanted", "available")
    return both.select("wanted", "available", drawn.alias("drawn"), (F.col("wanted") - drawn).alias("shortfall"))


def training_sample(
    stream: DataFrame, catalogue: DataFrame, size: int = 60, ratio: float = 1.0, buffer: int = 50, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """Positive windows and the negatives drawn for them.

    Precursor runs, positives and zones have a row or two per event and feed several later joins,
    so each is written once; of the free starts, of which there are nearly as many as samples, only
    those at the beginning of the draw are made.
    """
    precursors = materialise(precursor_runs(stream, chunk))
    positives = materialise(positive_starts(stream, catalogue, size, chunk=chunk, precursors=precursors))
    zones = materialise(forbidden_intervals(stream, positives, size, buffer, chunk=chunk, precursors=precursors))
    return positives, drawn_starts(stream, zones, int(positives.count() * ratio), size)


def training_windows(
    stream: DataFrame, catalogue: DataFrame, size: int = 60, ratio: float = 1.0, buffer: int = 50, chunk: int = CHUNK
) -> DataFrame:
    """Balanced windows from the labelled stream in one call."""
    positives, negatives = training_sample(stream, catalogue, size, ratio, buffer, chunk)
    return combine_windows(positives, materialise(negatives), chunk)


def combine_windows(positives: DataFrame, negatives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Union of both classes, numbered by first position: ``window_id, start_idx, event_sclk, label``."""
    pos = positives.select("start_idx", F.col("sclk").alias("event_sclk"), F.lit(1).alias("label"))
    neg = negatives.select("start_idx", F.lit(-1).cast("long").alias("event_sclk"), F.lit(0).alias("label"))
    return renumber(pos.unionByName(neg), "window_id", "event_sclk", by="start_idx", chunk=chunk)


def balance(df: DataFrame, key: str, label: str, per_class: int | None = None, bands: int = 4096) -> DataFrame:
    """Equal class sizes in portable-hash order: ``per_class`` each, or the smaller class's size.

    Ranks are taken inside hash bands and offset by the bands before, so a class that holds
    nearly all rows is still spread over many tasks.
    """
    rows = df.withColumn("_h", portable_hash(F.col(key)))
    rows = rows.withColumn("_band", F.floor(F.col("_h") / F.lit(2147483648 // bands)))
    sizes = rows.groupBy(label, "_band").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(label).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(label)
    sizes = sizes.select(
        label, "_band", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(whole).alias("_size")
    )
    least = sizes.agg(F.min("_size").alias("_least"))
    sizes = attach(sizes, least)
    want = F.col("_least") if per_class is None else F.least(F.col("_least"), F.lit(per_class))
    rank = F.row_number().over(Window.partitionBy(label, "_band").orderBy("_h", key))
    # classes × bands rows; the engine decides by their size how they meet.
    return (
        rows.join(sizes, [label, "_band"])
        .filter(F.col("_before") < want)
        .withColumn("rank_in_class", F.col("_before") + rank)
        .filter(F.col("rank_in_class") <= want)
        .select(*df.columns, "rank_in_class")
    )


def stratified_split(df: DataFrame, key: str, label: str, share: float = 0.8, bands: int = 4096) -> DataFrame:
    """Random split per class in portable-hash order. It mixes times; kept as an option only."""
    rows = df.withColumn("_h", portable_hash(F.col(key)))
    rows = rows.withColumn("_band", F.floor(F.col("_h") / F.lit(2147483648 // bands)))
    sizes = rows.groupBy(label, "_band").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(label).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        label,
        "_band",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy(label)).alias("_size"),
    )
    rank = F.row_number().over(Window.partitionBy(label, "_band").orderBy("_h", key))
    out = rows.join(sizes, [label, "_band"]).withColumn("_rank", F.col("_before") + rank)
    part = F.when(F.col("_rank") <= F.floor(F.col("_size") * share), "train").otherwise("test")
    return out.select(*df.columns, part.alias("part"))


def capacity(stream: DataFrame, positives: DataFrame, zones: DataFrame, size: int = 60) -> DataFrame:
    """Safe rows, how many disjoint windows fit in them, and the ratio to the positives."""
    marked = flag_inside(stream.select("idx"), merged_by_bin(zones, "lo", "hi"), "idx", "_hit")
    n = marked.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum(F.col("_hit").cast("long")), F.lit(0)).alias("forbidden_rows"))
    p = positives.agg(F.count(F.lit(1)).alias("positives"))
    safe = F.col("total_rows") - F.col("forbidden_rows")
    return attach(n, p).select(
        "total_rows", "forbidden_rows", safe.alias("safe_rows"),
        F.floor(safe / size).cast("long").alias("window_capacity"), "positives",
        F.try_divide(F.floor(safe / size), F.col("positives")).alias("capacity_ratio"),
    )


def anchored_subwindows(
    stream: DataFrame, catalogue: DataFrame, before: int = 150, size: int = 20, drop_ratio: float = 0.08, z: float = 1.0
) -> DataFrame:
    """Disjoint sub-windows of the samples before each event, with labels, rules and long-term stats.

    Each anchor owns at most ``before`` rows, so per-anchor frames are small whatever the data size.
    """
    rows = neighbourhood(
        stream.select("idx", "pressure", "gt_detection_win"),
        catalogue.filter(F.col("centre") >= 2).select("vortex", "centre"),
        "centre",
        before,
        -1,
    )
    w = Window.partitionBy("vortex").orderBy("idx")
    whole, upto = Window.partitionBy("vortex"), w.rowsBetween(Window.unboundedPreceding, 0)
    det = F.when(F.col("gt_detection_win"), F.col("idx"))
    rows = rows.select(
        "vortex", "centre", "idx", "pressure",
        (F.row_number().over(w) - 1).alias("_off"),
        F.avg("pressure").over(upto).alias("_lm"),
        F.stddev_samp("pressure").over(upto).alias("_ls"),
        F.coalesce(F.min(det).over(whole), F.col("centre")).alias("_r0"),
        F.coalesce(F.max(det).over(whole), F.col("centre")).alias("_r1"),
    )
    subs = rows.groupBy("vortex", F.floor(F.col("_off") / size).alias("sub")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("idx").alias("right_idx"), F.avg("pressure").alias("_m"),
        F.stddev_pop("pressure").alias("_sd"), F.min_by("pressure", "idx").alias("_p0"),
        F.max_by("pressure", "idx").alias("_p1"), F.max_by("_lm", "idx").alias("long_term_mean"),
        F.max_by("_ls", "idx").alias("long_term_std"), F.first("_r0").alias("_r0"), F.first("_r1").alias("_r1"),
    ).filter(F.col("_n") == size)
    fall = F.col("_p0") - F.col("_p1")
    fall_ratio = F.try_divide(fall, F.col("_p0"))
    zscore = F.when(F.col("_sd") > 0, fall / F.col("_sd")).otherwise(0.0)
    return subs.select(
        "vortex", "sub", "right_idx", F.col("right_idx").between(F.col("_r0"), F.col("_r1")).alias("ml_label"),
        (-fall).alias("pressure_change"), fall_ratio.alias("drop_ratio"), zscore.alias("z_score"),
        (fall_ratio >= drop_ratio).alias("scheme1"), (zscore >= z).alias("scheme2"),
        "long_term_mean", "long_term_std", (F.col("_m") - F.col("long_term_mean")).alias("trend"),
    )
