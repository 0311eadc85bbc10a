"""Summaries: classes, profiles, separations, correlations, regions, gaps."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import panes
from tidemark.operators.attach import attach
from tidemark.functions.scalars import ratio, safe_corr
from tidemark.operators.index import CHUNK, halo, in_chunk, rolling
from tidemark.operators.intervals import interval_join
from tidemark.operators.runs import run_rows


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Counts and percent by label. The totals are a window over one row per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return counts.withColumn("percent", F.col("n") / F.sum("n").over(whole) * 100)


def class_priors(df: DataFrame, by: str, label: str = "y") -> DataFrame:
    """Per split: counts, priors and the negative-to-positive ratio (null where there is no positive)."""
    pos = F.sum((F.col(label) == 1).cast("long"))
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), pos.alias("positives"))
    neg = F.col("total") - F.col("positives")
    return out.select(
        by,
        "total",
        "positives",
        neg.alias("negatives"),
        (F.col("positives") / F.col("total")).alias("prior_positive"),
        (neg / F.col("total")).alias("prior_negative"),
        F.when(F.col("positives") > 0, neg / F.col("positives")).alias("ratio_neg_to_pos"),
    )


def class_weights(priors: DataFrame) -> DataFrame:
    """Weights by method, scaled to sum two, plus the plain forms."""
    p, q = F.col("prior_positive"), F.col("prior_negative")
    n, pos, neg = F.col("total"), F.col("positives"), F.col("negatives")

    def scaled(name: str, w0: Column, w1: Column) -> Column:
        return F.struct(F.lit(name).alias("method"), (w0 * 2 / (w0 + w1)).alias("w0"), (w1 * 2 / (w0 + w1)).alias("w1"))

    def plain(name: str, w0: Column, w1: Column) -> Column:
        return F.struct(F.lit(name).alias("method"), w0.cast("double").alias("w0"), w1.cast("double").alias("w1"))

    methods = [
        scaled("inverse_freq", 1 / (2 * q), 1 / (2 * p)),
        scaled("balanced", 1 / (2 * q), 1 / (2 * p)),
        scaled("sqrt", F.sqrt(1 / (2 * q)), F.sqrt(1 / (2 * p))),
        scaled("prior_adjusted", F.lit(1.0), q / p),
        plain("n_over_2nc", n / (2 * neg), n / (2 * pos)),
        plain("neg_over_pos", F.lit(1.0), neg / pos),
        plain("sqrt_total", F.sqrt(n / (2 * neg)), F.sqrt(n / (2 * pos))),
    ]
    keep = [c for c in priors.columns if c == "split"]
    return priors.filter((pos > 0) & (neg > 0)).select(*keep, F.inline(F.array(*methods)))


def position_profile(rows: DataFrame, label: str = "label", value: str = "pressure") -> DataFrame:
    """Mean and deviation at each window position, per class side by side, and their difference."""
    v, y = F.col(value), F.col(label)
    one, zero = F.when(y == 1, v), F.when(y == 0, v)
    return (
        rows.groupBy("pos")
        .agg(
            F.avg(one).alias("mean_1"), F.stddev_samp(one).alias("std_1"),
            F.avg(zero).alias("mean_0"), F.stddev_samp(zero).alias("std_0"),
        )
        .withColumn("difference", F.col("mean_1") - F.col("mean_0"))
    )


def long_features(df: DataFrame, features: list[str], *keep: str) -> DataFrame:
    """One row per feature value; the fan-out happens inside the task, before partial aggregation."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.inline(pairs))


def feature_separation(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """Per feature: class means, deviations, ranges and |μ₁−μ₀| / (σ₁+σ₀)."""
    v, y = F.col("value"), F.col(label)
    one, zero = F.when(y == 1, v), F.when(y == 0, v)
    aggs = []
    for tag, e in (("1", one), ("0", zero)):
        aggs += [
            F.avg(e).alias(f"mean_{tag}"), F.stddev_samp(e).alias(f"std_{tag}"),
            F.min(e).alias(f"min_{tag}"), F.max(e).alias(f"max_{tag}"),
        ]
    gap = F.abs(F.col("mean_1") - F.col("mean_0"))
    return (
        long_features(df, features, label)
        .groupBy("feature")
        .agg(*aggs)
        .withColumn("separation", ratio(gap, F.col("std_1") + F.col("std_0")))
    )


def two_sample(df: DataFrame, value: str, label: str = "y") -> DataFrame:
    """Equal-variance t statistic, its degrees of freedom and Cohen's d, from one aggregate."""
    v, y = F.col(value), F.col(label)
    one, zero = F.when(y == 1, v), F.when(y == 0, v)
    a = df.agg(
        F.count(one).alias("n1"), F.avg(one).alias("m1"), F.var_samp(one).alias("v1"),
        F.count(zero).alias("n0"), F.avg(zero).alias("m0"), F.var_samp(zero).alias("v0"),
    )
    c = F.col
    dof = c("n1") + c("n0") - 2
    pooled = ((c("n1") - 1) * c("v1") + (c("n0") - 1) * c("v0")) / dof
    return a.select(
        "n1", "n0", dof.alias("dof"),
        F.try_divide(c("m1") - c("m0"), F.sqrt(pooled * (1 / c("n1") + 1 / c("n0")))).alias("t"),
        F.try_divide(F.abs(c("m1") - c("m0")), F.sqrt((c("v1") + c("v0")) / 2)).alias("cohens_d"),
    )


def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value by the continued fraction of the incomplete beta function (one result row)."""
    from math import exp, lgamma, log

    def tail(tv: float, d: float) -> float:
        x, a, b = d / (d + tv * tv), d / 2, 0.5
        if x <= 0 or x >= 1:
            return 1.0 if x >= 1 else 0.0
        swap = x >= (a + 1) / (a + b + 2)
        if swap:
            x, a, b = 1 - x, b, a
        front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
        f, c, dd = 1.0, 1.0, 0.0
        for k in range(500):
            h = k // 2
            if k == 0:
                num = 1.0
            elif k % 2 == 0:
                num = h * (b - h) * x / ((a + 2 * h - 1) * (a + 2 * h))
            else:
                num = -(a + h) * (a + b + h) * x / ((a + 2 * h) * (a + 2 * h + 1))
            dd = 1 / (1 + num * dd if abs(1 + num * dd) > 1e-300 else 1e-300)
            c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
            f *= c * dd
            if abs(1 - c * dd) < 1e-14:
                break
        part = front * (f - 1)
        return 1 - part if swap else part

    return pd.Series([tail(a, b) for a, b in zip(t, dof)], dtype="float64")


def correlation_matrix(df: DataFrame, features: list[str]) -> DataFrame:
    """Every pairwise Pearson correlation: ``f1, f2, r``.

    Each pair uses the rows in which both features are there (NaN counts as missing); ``r`` is null
    for a constant or empty feature, or one with infinite values. Lazy: each row is spread over the
    pairs inside its task, where it is aggregated again before the shuffle.
    """
    clean = df.select(*[F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features])
    pairs = list(combinations(range(len(features)), 2))
    values = clean.select(F.array(*features).alias("_v"))
    spread = values.select(F.explode(F.array(*[F.array(F.lit(i), F.lit(j)) for i, j in pairs])).alias("_p"), "_v")
    x, y = F.get("_v", F.col("_p")[0]), F.get("_v", F.col("_p")[1])
    r = spread.select(F.col("_p")[0].alias("_i"), F.col("_p")[1].alias("_j"), x.alias("_x"), y.alias("_y")).groupBy("_i", "_j").agg(
        safe_corr(F.col("_x"), F.col("_y")).alias("r")
    )
    names = F.array(*[F.lit(f) for f in features])
    return r.select(F.get(names, F.col("_i")).alias("f1"), F.get(names, F.col("_j")).alias("f2"), F.when(~F.isnan("r"), F.col("r")).alias("r"))


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """How two flags agree, with precision and recall of ``a`` against ``b``. Rows with a null flag count nowhere."""
    n = {"both": a & b, "only_a": a & ~b, "only_b": ~a & b, "neither": ~a & ~b}
    out = df.agg(*[F.coalesce(F.sum(e.cast("long")), F.lit(0).cast("long")).alias(k) for k, e in n.items()])
    c = F.col
    return out.select(
        "*",
        ratio(c("both"), c("both") + c("only_a")).alias("precision"),
        ratio(c("both"), c("both") + c("only_b")).alias("recall"),
    )


def by_sol(stream: DataFrame, flag: str, seconds: int = 86400) -> DataFrame:
    """Positives per sol (sols that have any) and how much of the covered sols was observed."""
    pos = stream.filter(flag).groupBy("sol").agg(F.count(F.lit(1)).alias("n"))
    per = pos.agg(
        F.avg("n").alias("mean_per_sol"), F.percentile("n", 0.5).alias("median_per_sol"),  # one row per sol
        F.max("n").alias("max_per_sol"), F.count(F.lit(1)).alias("sols_with_events"),
    )
    cover = stream.agg(
        (F.max("sol") - F.min("sol") + 1).alias("total_sols"), F.count(F.lit(1)).alias("_rows")
    ).withColumn("coverage", F.col("_rows") / (F.col("total_sols") * seconds))
    return attach(per, cover.drop("_rows"))


def run_lengths(runs: DataFrame) -> DataFrame:
    d = F.col("end_idx") - F.col("start_idx") + 1
    return runs.agg(
        F.count(F.lit(1)).alias("events"), F.avg(d).alias("mean_length"), F.min(d).alias("min_length"), F.max(d).alias("max_length")
    )


def signal_to_noise(stream: DataFrame, measures: list[str], inside: str) -> DataFrame:
    """Mean size of each change measure inside and outside events, their ratio, and the noise deviation."""
    long = long_features(stream, measures, inside).filter(F.col("value").isNotNull())
    v = F.abs("value")
    i, o = F.when(F.col(inside), v), F.when(~F.col(inside), v)
    return (
        long.groupBy("feature")
        .agg(F.avg(i).alias("inside_mean"), F.avg(o).alias("outside_mean"), F.stddev_pop(o).alias("noise_std"))
        .withColumn("snr", ratio(F.col("inside_mean"), F.col("outside_mean")))
    )


def scores_by_region(stream: DataFrame, score: str, regions: list[str], levels=(0.45, 0.5, 0.9)) -> DataFrame:
    """Score statistics inside each flagged region and the share of rows above fixed levels."""
    tags = F.array(*[F.when(F.col(r), F.lit(r)) for r in regions])
    rows = stream.select(score, F.explode(F.array_compact(tags)).alias("region"))
    shares = [F.avg((F.col(score) >= t).cast("double")).alias(f"share_{str(t).replace('0.', '')}") for t in levels]
    return rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
        F.min(score).alias("min_score"), *shares,
    )


def window_rollup(stream: DataFrame, labels: DataFrame, size: int = 60, step: int = 10, chunk: int = CHUNK) -> DataFrame:
    """Per window: whether any sample is flagged, with the window's label and score."""
    wanted = {"has_detection": panes.high(F.col("gt_detection_win")), "has_fwhm": panes.high(F.col("gt_fwhm"))}
    flags = panes.window_summary(stream, size, step, wanted, chunk).drop("start_idx", "end_idx")
    return labels.join(flags, "window_id", "left")


def event_profiles(stream: DataFrame, chunk: int = CHUNK, score: str = "p") -> DataFrame:
    """Per event: pressure range, fall from its first sample, length, mean and highest score.

    The row that closes an event belongs to its profile, as long as there is one.
    """
    open_rows = run_rows(stream, F.col("gt_fwhm") | F.col("gt_detection_win"), chunk)
    bounds = open_rows.groupBy(F.col("run_start").alias("start_idx")).agg((F.max("idx") + 1).alias("close_idx"))
    rows = interval_join(stream.select("idx", "pressure", score), bounds, "idx", "start_idx", "close_idx")
    p = F.col("pressure")
    return rows.groupBy("start_idx").agg(
        (F.max(p) - F.min(p)).alias("pressure_range"), (F.min_by(p, "idx") - F.min(p)).alias("pressure_drop"),
        F.count(F.lit(1)).alias("duration"), F.avg(score).alias("mean_score"), F.max(score).alias("max_score"),
    )


def mean_patterns(stream: DataFrame, kind: Column, reach: int = 60, value: str = "pressure", chunk: int = CHUNK) -> DataFrame:
    """Mean and deviation of the value, and of its step, at each relative position around anchors, per kind.

    ``kind`` names the anchors and is null on all other rows. The sums at each position are the
    cross-correlation of the anchors' indicator with the series: in a chunk with its halo one product per
    position, so that no row is copied to an anchor, however many there are.
    """
    steps = rolling(stream.select("idx", kind.cast("string").alias("kind"), F.col(value).cast("double").alias("v")), {"step": F.col("v") - F.lag("v").over(in_chunk())}, 1, chunk=chunk)
    level = stream.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("_level"))
    near = halo(attach(steps, level).withColumn("v", F.col("v") - F.col("_level")).drop("_level"), reach, reach, max(chunk, 2 * reach))

    def correlate(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows["idx"].to_numpy(), kind="stable")
        idx, own = rows["idx"].to_numpy()[order], rows["_own"].to_numpy()[order]
        # Places in the chunk's span; what is not there counts nothing.
        at, n = idx - idx[0] + reach, int(idx[-1] - idx[0]) + 1 + 2 * reach
        series = [np.zeros(n) for _ in range(6)]  # rows, values, their sum and squares, steps and their sum
        v, step = (rows[c].to_numpy()[order] for c in ("v", "step"))
        series[0][at] = 1
        for k, x in ((1, v), (4, step)):
            has = ~np.isnan(x)
            series[k][at[has]], series[k + 1][at[has]] = 1, x[has]
        series[3][at[~np.isnan(v)]] = v[~np.isnan(v)] ** 2
        names = np.array(rows["kind"].to_pylist(), object)[order]
        out: dict[str, list] = {c: [] for c in ("kind", "rel_pos", *_SUMS)}
        for name in sorted({x for x, o in zip(names, own) if o and x is not None}):
            marks = at[(names == name) & own]
            for r in range(-reach, reach + 1):
                out["kind"].append(name)
                out["rel_pos"].append(r)
                for c, s in zip(_SUMS, series):
                    out[c].append(float(s[marks + r].sum()))
        return pa.table({c: pa.array(x, pa.string() if c == "kind" else pa.int64() if c == "rel_pos" else pa.float64()) for c, x in out.items()})

    sums = near.groupBy("_chunk").applyInArrow(correlate, "kind string, rel_pos bigint, " + ", ".join(f"{c} double" for c in _SUMS))
    t = attach(sums.groupBy("kind", "rel_pos").agg(*[F.sum(c).alias(c) for c in _SUMS]).filter("_rows > 0"), level)
    mean = F.try_divide("_v", "_n")
    spread = F.sqrt(F.greatest(F.try_divide("_v2", "_n") - mean * mean, F.lit(0.0)))
    return t.select(
        "kind", "rel_pos", (F.col("_level") + mean).alias("mean_p"), spread.alias("std_p"), F.try_divide("_step", "_steps").alias("mean_step"), F.col("_rows").cast("long").alias("n")
    )


_SUMS = ("_rows", "_n", "_v", "_v2", "_steps", "_step")


def clock_gaps(stream: DataFrame, top: int = 5, chunk: int = CHUNK) -> DataFrame:
    """The commonest clock steps between neighbours."""
    steps = rolling(stream.select("idx", "sclk"), {"gap": F.col("sclk") - F.lag("sclk").over(in_chunk())}, 1, chunk=chunk)
    counts = steps.filter(F.col("gap").isNotNull()).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "gap").limit(top)
