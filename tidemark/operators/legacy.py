"""Feature sets of the earlier detectors: detrended, shape, artefact, smoothing, sequences."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions import arrays
from tidemark.operators.index import CHUNK, Prefix, drop_halo, extreme, halo, in_chunk, rolling, running_sums
from tidemark.operators.windows import savgol_weights, window_arrays

DETRENDED = [
    "mean_50", "std_50", "min_50", "max_50", "diff_mean_50", "diff_std_50",
    "mean_10", "std_10", "diff_mean_10", "diff_std_10",
]
SHAPE = [
    "mean_pressure", "std_pressure", "min_pressure", "max_pressure", "pressure_range",
    "rate_of_change_mean", "rate_of_change_std", "rate_of_change_max", "peak_count", "valley_count",
]
ARTEFACT = [
    "min_slope", "total_drop_after_initial", "avg_slope_after_sharpest", "total_drop_after_sharpest",
    "consecutive_negative_slopes", "total_drop", "normalized_median_pressure", "normalized_pressure_std",
    "normalized_slope_std",
]


def detrended_features(stream: DataFrame, size: int = 50, recent: int = 10, average: int = 500, chunk: int = CHUNK):
    """Ten features of pressure minus its moving average, for every end row of a full window.

    One halo serves the average and the frames on top of it, so the stream moves once. Means and
    deviations come from running sums and the mean step is the difference of the frame's ends.
    """
    near = halo(stream.select("idx", "pressure"), average + size - 1, chunk=chunk)
    near = near.withColumn("_p", F.col("pressure") - F.first("pressure").over(in_chunk()))
    level = Prefix("_p")
    near = level.prepare(near).select("idx", "_own", "_chunk", (F.col("_p") - level.mean(average)).alias("_d"))
    near = near.withColumn("_dd", F.col("_d") - F.lag("_d", 1).over(in_chunk()))
    low, low_all = extreme(F.min, "_d", size)
    high, high_all = extreme(F.max, "_d", size)
    d, dd = Prefix("_d", squares=True), Prefix("_dd", squares=True)
    near = dd.prepare(d.prepare(near)).select("*", low, high)

    def step_mean(n: int):
        return (F.col("_d") - F.lag("_d", n - 1).over(in_chunk())) / (n - 1)

    cols = [
        d.mean(size), d.std(size), low_all, high_all, step_mean(size), dd.std(size - 1),
        d.mean(recent), d.std(recent), step_mean(recent), dd.std(recent - 1),
    ]
    out = near.select("idx", "_own", "_chunk", *[c.alias(n) for c, n in zip(cols, DETRENDED)])
    return drop_halo(out).filter(F.col("idx") >= size - 1)


def shape_features(windows: DataFrame, samples: str = "samples") -> DataFrame:
    a = F.col(samples)
    keep = [c for c in windows.columns if c != samples]
    # Moments and gradient are columns of their own, so that each is evaluated once per window.
    base = windows.select("*", arrays.moments(a).alias("_am"), arrays.array_gradient(a).alias("_g"))
    base = base.select("*", arrays.moments(F.col("_g")).alias("_gm"))
    mean = F.col("_am.mean")
    values = [
        mean, F.col("_am.std"), F.array_min(a), F.array_max(a), F.array_max(a) - F.array_min(a),
        F.col("_gm.mean"), F.col("_gm.std"), F.greatest(F.array_max("_g"), -F.array_min("_g")),
        arrays.peak_count(a, mean), arrays.peak_count(a, mean, valleys=True),
    ]
    return base.select(*keep, *[v.alias(n) for v, n in zip(values, SHAPE)])


def expanding_stats(stream: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Mean and sample deviation of everything up to each row, from carried running sums.

    Sums are taken about the overall mean so that the variance keeps its digits.
    """
    centre = stream.agg(F.avg("pressure").alias("_c"))
    d = F.col("pressure") - F.col("_c")
    s = running_sums(
        attach(stream, centre), {"_n": F.lit(1), "_s1": d, "_s2": d * d}, chunk=chunk
    )
    n = F.col("_n")
    var = (F.col("_s2") - F.col("_s1") * F.col("_s1") / n) / (n - 1)
    return s.select(
        *stream.columns,
        (F.col("_c") + F.col("_s1") / n).alias("long_term_mean"),
        F.when(n > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("long_term_std"),
    )


def artefact_windows(stream: DataFrame, size: int = 60, step: int = 50, chunk: int = CHUNK) -> DataFrame:
    """Trailing windows with exclusive ends ``size, size+step, …`` below the stream length."""
    n = stream.agg((F.max("idx") + 1).alias("_rows"))
    arrs = window_arrays(stream, size, step, chunk=chunk)
    return (
        attach(arrs, n)
        .filter(F.col("end_idx") + 1 < F.col("_rows"))
        .select((F.col("end_idx") + 1).alias("end_excl"), "samples")
    )


def artefact_features(windows: DataFrame, lookahead: int = 5) -> DataFrame:
    a = F.col("samples")
    d = F.col("_d")
    n = F.size(a)
    sharp, first = F.col("_sharp"), F.col("_first")
    w = windows.withColumn("_d", arrays.array_diff(a))
    w = w.withColumn("_am", arrays.moments(a)).withColumn("_dm", arrays.moments(d))
    # 1-based positions of the steepest and of the first falling step.
    w = w.withColumn("_sharp", F.array_position(d, F.array_min(d)).cast("int")).withColumn(
        "_first", F.array_position(F.transform(d, lambda x: x < 0), F.lit(True)).cast("int")
    )
    last = F.element_at(a, -1)
    at_sharp = F.element_at(a, sharp)
    stop = F.least(sharp + lookahead, n)
    tail = F.slice(d, sharp + 1, n)
    rise = F.array_position(F.transform(tail, lambda x: x < 0), F.lit(False)).cast("int")
    values = [
        F.array_min(d),
        F.when(first > 0, last - F.element_at(a, F.greatest(first, F.lit(1)))).otherwise(0.0),
        (F.element_at(a, stop) - at_sharp) / (stop - sharp),
        last - at_sharp,
        F.when(rise > 0, rise - 1).otherwise(F.size(tail)),
        last - F.element_at(a, 1),
        arrays.array_median(a) - F.col("_am.mean"),
        F.col("_am.std"),
        F.col("_dm.std") / (F.col("_am.std") + 1e-8),
    ]
    keep = [c for c in windows.columns if c != "samples"]
    return w.select(*keep, *[v.alias(name) for v, name in zip(values, ARTEFACT)])


def artefact_rule(
    sharp_drop: float = -0.35, slope_after: float = -0.1, after_initial: float = 0.1, after_sharpest: float = -0.75
) -> Column:
    c = F.col
    return (
        ((c("min_slope") < sharp_drop) & (c("avg_slope_after_sharpest") > slope_after))
        | (c("total_drop_after_initial") < after_initial)
        | (c("total_drop_after_sharpest") < after_sharpest)
    )


def post_filter_keeps(sharp_drop: float = -0.35, after_initial: float = 0.1, slope_after: float = -0.3) -> Column:
    """Whether a positive survives the three shape tests."""
    c = F.col
    return (
        (c("min_slope") >= sharp_drop)
        & (c("total_drop_after_initial") < after_initial)
        & (c("avg_slope_after_sharpest") > slope_after)
    )


def savgol(stream: DataFrame, lengths=(5, 11, 21), chunk: int = CHUNK, value: str = "pressure") -> DataFrame:
    """Quadratic smoothing: each row is the least-squares parabola of its ``n`` neighbours, read at the row.

    The first and last ``n // 2`` rows of the stream read the parabola of the first or last ``n`` rows at
    their own place. Null where a frame holds a null, or the stream is shorter than ``n``.

    Inner rows are one weighted sum of their neighbours. The two ends are a few rows, fitted once as
    constants of the plan.
    """
    reach, longest, w = max(lengths) // 2, max(lengths), in_chunk()
    bounds = stream.agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
    ends = attach(stream.select("idx", value), bounds).filter((F.col("idx") - F.col("_lo") < longest) | (F.col("_hi") - F.col("idx") < longest))
    # At most two times the longest frame.
    ends = ends.agg(F.array_sort(F.collect_list(F.struct("idx", F.col(value).cast("double").alias("v")))).alias("_e"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

    def parabola(n: int, at) -> Column:
        """Coefficients of the frame whose readings are ``at(k)``, k from -h to h."""
        h = n // 2
        s0, s2, s4 = (float(sum(k**e for k in range(-h, h + 1))) for e in (0, 2, 4))
        weighted = lambda f: reduce(add, [F.lit(f[k + h]) * at(k) for k in range(-h, h + 1)])
        slope, bend = [k / s2 for k in range(-h, h + 1)], [(s0 * k * k - s2) / (s0 * s4 - s2 * s2) for k in range(-h, h + 1)]
        return F.struct(weighted(savgol_weights(n)).alias("a0"), weighted(slope).alias("a1"), weighted(bend).alias("a2"))

    fits = []
    for n in lengths:
        h, size = n // 2, F.size("_e")
        long_enough = F.col("_hi") - F.col("_lo") >= n - 1
        head = parabola(n, lambda k, h=h: F.get("_e", F.lit(h + k))["v"])
        tail = parabola(n, lambda k, h=h, size=size: F.get("_e", size - 1 - h + k)["v"])
        fits += [F.when(long_enough, head).alias(f"_head_{n}"), F.when(long_enough, tail).alias(f"_tail_{n}")]
    near = halo(stream, reach, reach, chunk)
    inner = []
    for n in lengths:
        at = {k: (F.lag(value, -k) if k < 0 else F.lead(value, k)).over(w) for k in range(-(n // 2), n // 2 + 1)}
        inner.append(reduce(add, [F.lit(c) * at[k] for c, k in zip(savgol_weights(n), at)]).alias(f"smooth_{n}"))
    out = attach(drop_halo(near.select("*", *inner)), ends.select("_lo", "_hi", *fits))

    def read(name: str, x: Column) -> Column:
        x = x.cast("double")
        return F.col(name)["a0"] + F.col(name)["a1"] * x + F.col(name)["a2"] * x * x

    smooth = []
    for n in lengths:
        h, i = n // 2, F.col("idx")
        first, last = i - F.col("_lo"), F.col("_hi") - i
        edge = F.when(first < h, read(f"_head_{n}", first - h)).when(last < h, read(f"_tail_{n}", F.lit(h) - last))
        smooth.append(edge.otherwise(F.col(f"smooth_{n}")).alias(f"smooth_{n}"))
    return out.select(*stream.columns, *smooth)


def corrected_skew(skew: Column, n: Column) -> Column:
    """Population skewness to the bias-corrected sample form; null under three values."""
    return F.when(n >= 3, skew * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(excess: Column, n: Column) -> Column:
    """Population excess kurtosis to the bias-corrected sample form; null under four values."""
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6))


def sequence_features(stream: DataFrame, chunk: int = CHUNK, size: int = 60, short: int = 20) -> DataFrame:
    """Local detrend, second difference and rolling bias-corrected skew and kurtosis.

    The second difference is taken with the first value repeated twice in front of the stream.
    Rolling moments are sums of powers about the current value, spelled out over ``short`` lags.
    """
    w = in_chunk()
    near = halo(stream.select("idx", "pressure"), size - 1, chunk=chunk)
    near = near.withColumn("_p", F.col("pressure") - F.first("pressure").over(w))
    level = Prefix("_p")
    lags = [F.lag("_p", k).over(w).alias(f"_l{k}") for k in range(1, short)]
    near = level.prepare(near).select("*", *lags, level.mean(size).alias("_level"))
    p = F.col("_p")
    back1, back2 = F.coalesce("_l1", "_p"), F.coalesce("_l2", "_l1", "_p")
    # The current value itself has distance 0 and adds nothing.
    steps = F.array_compact(F.array(*[F.col(f"_l{k}") - p for k in range(1, short)]))
    n = F.size("_steps") + 1
    zero = F.struct(*[F.lit(0.0).alias(f"s{j}") for j in range(1, 5)])

    def add(s, x):
        x2 = x * x
        return F.struct(
            (s["s1"] + x).alias("s1"), (s["s2"] + x2).alias("s2"), (s["s3"] + x2 * x).alias("s3"), (s["s4"] + x2 * x2).alias("s4")
        )

    near = near.filter("_own").select(
        "idx", (p - F.col("_level")).alias("detrended"), (p - 2 * back1 + back2).alias("acceleration"), steps.alias("_steps")
    )
    near = near.select("*", n.alias("_n"), F.aggregate("_steps", zero, add).alias("_s"))
    m = F.col("_s.s1") / F.col("_n")
    r2, r3, r4 = (F.col(f"_s.s{j}") / F.col("_n") for j in (2, 3, 4))
    m2 = r2 - m * m
    m3 = r3 - 3 * m * r2 + 2 * m * m * m
    m4 = r4 - 4 * m * r3 + 6 * m * m * r2 - 3 * m * m * m * m
    # Variance this small is rounding of a flat frame.
    flat = m2 <= 1e-14 * F.greatest(r2, F.lit(1e-300))
    skew, kurt = F.when(~flat, m3 / F.pow(m2, 1.5)), F.when(~flat, m4 / (m2 * m2) - 3)
    return near.select(
        "idx", "detrended", "acceleration",
        F.coalesce(corrected_skew(skew, F.col("_n")), F.lit(0.0)).alias("roll_skew"),
        F.coalesce(corrected_kurtosis(kurt, F.col("_n")), F.lit(0.0)).alias("roll_kurt"),
    )
