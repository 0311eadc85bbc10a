"""Fifteen per-window features in four variants, from mergeable moments.

Sliding windows overlap (size 60, step 10 puts each sample in six of them), so samples are reduced
once to *panes* of ``gcd`` length and windows are frames over panes: the exchange carries one
summary row per pane instead of six copies of every sample. Sums are taken about a central value,
because pressures sit near 745 with a spread of hundredths.

Variants keep the four definitions that share these names apart: ``A`` training, ``B`` scoring,
``C`` extended, ``D`` display.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panes
from tidemark.operators.attach import attach
from tidemark.operators.index import CHUNK, chunk_of, halo, in_chunk, rolling

#: The names of the fifteen features, in their order.
FEATURES = [
    "overall_slope", "first_half_slope", "second_half_slope", "trend_consistency", "pressure_drop",
    "drop_rate", "min_position", "mean", "std", "range", "first_half_mean", "second_half_mean",
    "mean_ratio", "min_zscore", "anomaly_strength",
]
VARIANTS = ("A", "B", "C", "D")
ROLL = 10  # samples in the short slopes of variant B


def features_of(variant: str) -> list[str]:
    return [f for f in FEATURES if not (variant == "C" and f == "range")]


def global_stats(rows: DataFrame, column: str = "pressure") -> DataFrame:
    """One row ``g_mean, g_std`` (sample deviation) of the reference rows, usually the training split."""
    return rows.agg(F.avg(column).alias("g_mean"), F.stddev_samp(column).alias("g_std"))


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the one row of :func:`global_stats`."""
    return attach(df, stats)


def short_slope(value: Column, window) -> Column:
    """Least-squares slope of the ten samples that start at each row (null where they run out)."""
    centre = (ROLL - 1) / 2
    spread = sum((j - centre) ** 2 for j in range(ROLL))
    total = None
    for j in range(ROLL):
        term = F.lead(value, j).over(window) * F.lit((j - centre) / spread)
        total = term if total is None else total + term
    return total


def _slope(n: int, s1: Column, sx: Column) -> Column:
    """OLS slope over positions 0..n-1 from Σd and Σpos·d."""
    if n < 2:
        return F.lit(0.0)
    sum_x = n * (n - 1) / 2
    spread = n * ((n - 1) * n * (2 * n - 1) / 6) - sum_x**2
    return (n * sx - sum_x * s1) / spread


def finish(base: DataFrame, variant: str, size: int) -> DataFrame:
    """Turn window base columns into the features of one variant.

    Base columns: ``b_mean b_std b_slope b_slope1 b_slope2 b_mean1 b_mean2 b_min b_arg b_max b_first``
    and, for variant B, ``b_step`` (largest single-step fall) and ``b_roll_std``.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    c = F.col
    span = c("b_max") - c("b_min")
    if variant == "B":
        consistency = F.when(c("b_roll_std") > 0, 1.0 / (1.0 + c("b_roll_std"))).otherwise(1.0)
        drop, rate = span, F.greatest(F.lit(0.0), c("b_step"))
    else:
        consistency = F.abs(c("b_slope1") - c("b_slope2"))
        drop = span if variant == "C" else c("b_first") - c("b_min")
        rate = F.when(c("b_arg") > 0, drop / c("b_arg")).otherwise(0.0)
    position = c("b_arg") / F.lit(float(size if variant == "D" else size - 1))
    global_z = F.try_divide(c("b_min") - c("g_mean"), c("g_std"))
    if variant in ("A", "C"):
        local_z = F.when(c("b_std") > 0, (c("b_min") - c("b_mean")) / c("b_std")).otherwise(0.0)
        zscore = F.when(c("g_std") > 0, global_z).otherwise(local_z)
        strength = F.when(c("b_std") > 0, F.abs(c("b_min") - c("b_mean")) / c("b_std")).otherwise(0.0)
    elif variant == "B":
        zscore = F.when(c("g_std") > 0, global_z).otherwise(0.0)
        fitted = c("b_mean") + c("b_slope") * (c("b_arg") - (size - 1) / 2.0)
        strength = F.abs(c("b_min") - fitted)
    else:
        zscore = global_z
        strength = F.abs(global_z)
    values = {
        "overall_slope": c("b_slope"),
        "first_half_slope": c("b_slope1"),
        "second_half_slope": c("b_slope2"),
        "trend_consistency": consistency,
        "pressure_drop": drop,
        "drop_rate": rate,
        "min_position": position,
        "mean": c("b_mean"),
        "std": c("b_std"),
        "range": span,
        "first_half_mean": c("b_mean1"),
        "second_half_mean": c("b_mean2"),
        "mean_ratio": F.when(c("b_mean1") != 0, c("b_mean2") / c("b_mean1")).otherwise(1.0),
        "min_zscore": zscore,
        "anomaly_strength": strength,
    }
    keep = [n for n in base.columns if not n.startswith(("b_", "g_"))]
    return base.select(*keep, F.lit(variant).alias("variant"), *[values[f].alias(f) for f in features_of(variant)])


def pane_length(size: int, step: int, variant: str = "A") -> int:
    p = gcd(gcd(step, size // 2), size)
    return gcd(p, ROLL) if variant == "B" else p


def sliding_base(
    stream: DataFrame,
    size: int,
    step: int,
    stats: DataFrame,
    variant: str = "A",
    flags: tuple[str, ...] = (),
    value: str = "pressure",
    chunk: int = CHUNK,
) -> DataFrame:
    """Base columns of every full window ``[k*step, k*step+size-1]`` of a dense stream.

    Also returns start and end position and clock, and the last value of each flag. A window counts
    only if all of its readings are there; one with a null reading is dropped, here as in
    :func:`window_base` and :func:`tidemark.operators.windows.window_arrays`.
    """
    width = pane_length(size, step, variant)
    panes_in = size // width
    half = (size // 2) // width
    v = F.col(value)
    rows = stream.select("idx", "sclk", *flags, v)
    extra = []
    if variant == "B":
        rows = rolling(
            rows,
            {"_roll": short_slope(v, in_chunk()), "_step": F.lag(v, 1).over(in_chunk()) - v},
            before=1,
            after=ROLL - 1,
            chunk=chunk,
        )
        first_row = F.col("idx") % width == 0
        extra = [
            F.max(F.when(~first_row, F.col("_step"))).alias("_step_in"),
            F.max(F.when(first_row, F.col("_step"))).alias("_step_cross"),
            F.sum("_roll").alias("_r1"),
            F.sum(F.col("_roll") * F.col("_roll")).alias("_r2"),
        ]
    d = v - F.col("g_mean")
    off = F.col("idx") % width
    summed = (
        with_stats(rows, stats)
        .groupBy(chunk_of("idx", width).alias("pane"))
        .agg(
            F.count(v).alias("_n"),
            F.sum(d).alias("_s1"),
            F.sum(d * d).alias("_s2"),
            F.sum(off * d).alias("_sx"),
            F.min(F.struct(v.alias("v"), F.col("idx").alias("i"))).alias("_mn"),
            F.max(v).alias("_mx"),
            F.min_by(v, "idx").alias("_first"),
            F.min("sclk").alias("_sclk0"),
            F.max("sclk").alias("_sclk1"),
            *[F.max_by(f, "idx").alias(f"_last_{f}") for f in flags],
            *extra,
        )
    )
    pane_chunk = max(panes_in, min(chunk // width, 1 << 16))
    spread = halo(summed, 0, panes_in - 1, pane_chunk, by="pane")
    # Position of the pane inside its chunk keeps Σpos·d free of large cancelling terms.
    local = F.col("pane") - F.col("_chunk") * pane_chunk
    spread = spread.withColumn("_at", local * width).withColumn("_sx", F.col("_sx") + F.col("_at") * F.col("_s1"))

    w = in_chunk("pane")

    def frame(a: int, b: int):
        return w.rowsBetween(a, b)

    def moment(name: str, a: int, b: int) -> Column:
        return F.sum(name).over(frame(a, b))

    full, one, two = (0, panes_in - 1), (0, half - 1), (half, panes_in - 1)
    cols = {"w_n": moment("_n", *full)}
    for tag, f in (("", full), ("1", one), ("2", two)):
        cols[f"w_s1{tag}"] = moment("_s1", *f)
        cols[f"w_sx{tag}"] = moment("_sx", *f)
    cols |= {
        "w_s2": moment("_s2", *full),
        "w_mn": F.min("_mn").over(frame(*full)),
        "w_mx": F.max("_mx").over(frame(*full)),
        "end_sclk": F.max("_sclk1").over(frame(*full)),
        **{f"last_{f}": F.last(f"_last_{f}").over(frame(*full)) for f in flags},
    }
    if variant == "B":
        starts = (size - ROLL) // width
        cols |= {
            "w_r1": moment("_r1", 0, starts - 1),
            "w_r2": moment("_r2", 0, starts - 1),
            "w_step": F.greatest(
                F.max("_step_in").over(frame(*full)), F.max("_step_cross").over(frame(1, panes_in - 1))
            ),
        }
    windows = spread.select("*", *[e.alias(n) for n, e in cols.items()]).filter(
        F.col("_own") & (F.col("w_n") == size) & (F.col("pane") % (step // width) == 0)
    )
    c = F.col
    flat = c("w_mx") == c("w_mn.v")
    n1, n2 = size // 2, size - size // 2

    def centred_sx(tag: str, shift: int) -> Column:
        return c(f"w_sx{tag}") - (c("_at") + shift) * c(f"w_s1{tag}")

    base = {
        "b_mean": c("g_mean") + c("w_s1") / size,
        "b_std": F.when(flat, 0.0).otherwise(
            F.sqrt(F.greatest(c("w_s2") / size - F.pow(c("w_s1") / size, 2), F.lit(0.0)))
        ),
        "b_slope": F.when(flat, 0.0).otherwise(_slope(size, c("w_s1"), centred_sx("", 0))),
        "b_slope1": _slope(n1, c("w_s11"), centred_sx("1", 0)),
        "b_slope2": _slope(n2, c("w_s12"), centred_sx("2", n1)),
        "b_mean1": c("g_mean") + c("w_s11") / n1,
        "b_mean2": c("g_mean") + c("w_s12") / n2,
        "b_min": c("w_mn.v"),
        "b_arg": c("w_mn.i") - c("pane") * width,
        "b_max": c("w_mx"),
        "b_first": c("_first"),
    }
    if variant == "B":
        m = float(size - ROLL)
        base["b_step"] = c("w_step")
        base["b_roll_std"] = F.when(flat, 0.0).otherwise(
            F.sqrt(F.greatest(c("w_r2") / m - F.pow(c("w_r1") / m, 2), F.lit(0.0)))
        )
    start = c("pane") * width
    return with_stats(windows, stats).select(
        chunk_of(start, step).alias("window_id"),
        start.alias("start_idx"),
        (start + size - 1).alias("end_idx"),
        c("_sclk0").alias("start_sclk"),
        "end_sclk",
        *[c(f"last_{f}") for f in flags],
        *[e.alias(n) for n, e in base.items()],
        "g_mean",
        "g_std",
    )


def sliding_features(stream: DataFrame, stats: DataFrame, variant: str = "A", size: int = 60, step: int = 10, **kw):
    return finish(sliding_base(stream, size, step, stats, variant, **kw), variant, size)


def window_base(rows: DataFrame, keys: list[str], size: int, variant: str = "A", value: str = "pressure") -> DataFrame:
    """Base columns of long-form windows (``keys``, ``pos``, value); windows of another length are dropped.

    A window holds ``size`` rows, so grouping by it cannot be skewed.
    """
    v, pos = F.col(value), F.col("pos")
    half = size // 2
    one, two = F.when(pos < half, v), F.when(pos >= half, v)
    if variant == "B":
        w = Window.partitionBy(*keys).orderBy("pos")
        rows = rows.select(
            *keys, "pos", v, short_slope(v, w).alias("_roll"), (F.lag(v, 1).over(w) - v).alias("_step")
        )
        # The last start is left out: starts run over 0 .. size-ROLL-1.
        extra = [
            F.max("_step").alias("b_step"),
            F.stddev_pop(F.when(pos < size - ROLL, F.col("_roll"))).alias("b_roll_std"),
        ]
    else:
        extra = []
    x = pos.cast("double")
    return (
        rows.groupBy(*keys)
        .agg(
            F.count(v).alias("_n"),
            F.avg(v).alias("b_mean"),
            F.stddev_pop(v).alias("b_std"),
            F.regr_slope(v, x).alias("b_slope"),
            F.regr_slope(one, x).alias("b_slope1"),
            F.regr_slope(two, x).alias("b_slope2"),
            F.avg(one).alias("b_mean1"),
            F.avg(two).alias("b_mean2"),
            F.min(v).alias("b_min"),
            F.min(F.struct(v.alias("v"), pos.alias("i"))).getField("i").alias("b_arg"),
            F.max(v).alias("b_max"),
            F.min_by(v, "pos").alias("b_first"),
            *extra,
        )
        .filter(F.col("_n") == size)
        .drop("_n")
    )


def window_features(
    rows: DataFrame, stats: DataFrame, keys: list[str], variant: str = "A", size: int = 60, value: str = "pressure"
) -> DataFrame:
    return finish(with_stats(window_base(rows, keys, size, variant, value), stats), variant, size)


def hit_features(rows: DataFrame, keys: list[str], size: int = 60) -> DataFrame:
    """Autoencoder-hit features; null where every reading of the window is null."""
    hits, positive = F.col("autoencoder_window_hits"), F.col("autoencoder_positive_hit")
    return rows.groupBy(*keys).agg(
        F.avg(hits).alias("autoencoder_window_hits_mean"),
        F.max((positive > 0).cast("double")).alias("autoencoder_positive_hit_binary"),
        (F.sum(hits) / size).alias("autoencoder_hit_ratio"),
    )


def sliding_hit_features(stream: DataFrame, size: int = 60, step: int = 10, chunk: int = CHUNK) -> DataFrame:
    """:func:`hit_features` of every full sliding window, from pane summaries."""
    hits, positive = F.col("autoencoder_window_hits"), F.col("autoencoder_positive_hit")
    wanted = {"_total": panes.total(hits), "_n": panes.count(hits), "_any": panes.high((positive > 0).cast("double"))}
    out = panes.window_summary(stream, size, step, wanted, chunk)
    return out.select(
        "window_id",
        F.try_divide("_total", "_n").alias("autoencoder_window_hits_mean"),
        F.col("_any").alias("autoencoder_positive_hit_binary"),
        (F.col("_total") / size).alias("autoencoder_hit_ratio"),
    )
