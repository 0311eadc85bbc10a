"""Per-window features: the four variants, statistics, hits, smoothing and legacy sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays
from tidemark.operators import features as ft
from tidemark.operators import legacy, panes, splits, windows
from tidemark.operators.index import rolling, rolling_mean
from tidemark.operators.sampling import anchored_subwindows
from tidemark.plans.base import (
    SIZE, STEP, big, catalogue, chunk, i8, q6, query, r6, raw_stream, sql, stream, wends,
)
from tidemark.plans.q_positions import SPLIT_SQL

STATS_SQL = """
gs AS (SELECT avg(pressure) AS g_mean, stddev_samp(pressure) AS g_std FROM sp WHERE split = 'train')"""

LONG_SQL = """
wl AS (SELECT window_id, label, o AS pos, s.pressure, s.hits, s.pos_hit, s.idx
       FROM wend, (SELECT unnest(range(60)) AS o) JOIN st s ON s.idx = start_idx + o)"""

# Straightforward per-window aggregates over the long form ``wl``.
BASE_SQL = """
wm AS (SELECT window_id, min(pressure) AS mn FROM wl GROUP BY 1),
wa AS (SELECT wl.window_id, min(pos) AS arg FROM wl JOIN wm ON wl.window_id = wm.window_id AND pressure = mn GROUP BY 1),
wb AS (
  SELECT window_id, avg(pressure) AS mean, stddev_pop(pressure) AS std, min(pressure) AS mn, max(pressure) AS mx,
    regr_slope(pressure, pos) AS slope, regr_intercept(pressure, pos) AS icpt,
    regr_slope(CASE WHEN pos < 30 THEN pressure END, pos) AS s1,
    regr_slope(CASE WHEN pos >= 30 THEN pressure END, pos) AS s2,
    avg(CASE WHEN pos < 30 THEN pressure END) AS m1, avg(CASE WHEN pos >= 30 THEN pressure END) AS m2,
    max(CASE WHEN pos = 0 THEN pressure END) AS first_p
  FROM wl GROUP BY 1),
wf AS (SELECT wb.*, arg, g_mean, g_std FROM wb JOIN wa USING (window_id), gs)"""

ROLL_SQL = """
rl AS (SELECT a.idx, regr_slope(b.pressure, o) AS rs
       FROM st a, (SELECT unnest(range(10)) AS o) JOIN st b ON b.idx = a.idx + o GROUP BY a.idx),
wr AS (SELECT window_id, stddev_pop(rs) AS rstd FROM wl JOIN rl USING (idx) WHERE pos < 50 GROUP BY 1),
ws AS (SELECT window_id, max(prev - pressure) AS stp FROM
         (SELECT *, lag(pressure) OVER (PARTITION BY window_id ORDER BY pos) AS prev FROM wl) GROUP BY 1)"""


def feature_sql(variant: str, source: str = "wf", extra: str = "") -> str:
    zl = "CASE WHEN std > 0 THEN (mn - mean) / std ELSE 0.0 END"
    gz = "(mn - g_mean) / g_std"
    e = {
        "overall_slope": "slope",
        "first_half_slope": "s1",
        "second_half_slope": "s2",
        "trend_consistency": "abs(s1 - s2)",
        "pressure_drop": "first_p - mn",
        "drop_rate": "CASE WHEN arg > 0 THEN (first_p - mn) / arg ELSE 0.0 END",
        "min_position": "arg / 59.0",
        "mean": "mean",
        "std": "std",
        "range": "mx - mn",
        "first_half_mean": "m1",
        "second_half_mean": "m2",
        "mean_ratio": "CASE WHEN m1 <> 0 THEN m2 / m1 ELSE 1.0 END",
        "min_zscore": f"CASE WHEN g_std > 0 THEN {gz} ELSE {zl} END",
        "anomaly_strength": "CASE WHEN std > 0 THEN abs(mn - mean) / std ELSE 0.0 END",
    }
    if variant == "B":
        e |= {
            "trend_consistency": "CASE WHEN rstd > 0 THEN 1.0 / (1.0 + rstd) ELSE 1.0 END",
            "pressure_drop": "mx - mn",
            "drop_rate": "greatest(0.0, stp)",
            "anomaly_strength": "abs(mn - (slope * arg + icpt))",
        }
    if variant == "C":
        e |= {
            "pressure_drop": "mx - mn",
            "drop_rate": "CASE WHEN arg > 0 THEN (mx - mn) / arg ELSE 0.0 END",
        }
        del e["range"]
    if variant == "D":
        e |= {"min_position": "arg / 60.0", "min_zscore": gz, "anomaly_strength": f"abs({gz})"}
    # The shift takes exact decimal ties (a fall over 32 samples, say) off the rounding edge.
    e["drop_rate"] = f"({e['drop_rate']}) + 1e-9"
    return f"SELECT {extra} {', '.join(q6(v, k) for k, v in e.items())} FROM {source}"


def rounded(df, variant: str, *keep):
    shift = {"drop_rate": 1e-9}
    return df.select(*keep, *[r6(F.col(f) + shift.get(f, 0.0), f) for f in ft.features_of(variant)])


# The stream with every 97th reading missing; windows that miss one are dropped.
HOLES_SQL = """
sh AS (SELECT * REPLACE (CASE WHEN idx % 97 = 0 THEN NULL ELSE pressure END AS pressure) FROM st),
gs AS (SELECT avg(sh.pressure) AS g_mean, stddev_samp(sh.pressure) AS g_std FROM sh JOIN sp ON sp.idx = sh.idx WHERE split = 'train'),
wl AS (SELECT window_id, label, o AS pos, s.pressure, s.idx FROM wend, (SELECT unnest(range(60)) AS o) JOIN sh s ON s.idx = start_idx + o
       WHERE window_id NOT IN (SELECT window_id FROM wend, (SELECT unnest(range(60)) AS o) JOIN sh s ON s.idx = start_idx + o WHERE s.pressure IS NULL))"""


def train_stats(spark, sf):
    train = splits.position_split(stream(spark, sf)).filter(F.col("split") == "train")
    return ft.global_stats(train)


def sliding(spark, sf, variant: str):
    return ft.sliding_features(
        stream(spark, sf), train_stats(spark, sf), variant, SIZE, STEP,
        flags=("gt_detection_win", "gt_fwhm"), chunk=chunk(spark, sf),
    )


@query(
    "w1_f_sliding_features_a",
    sql(
        feature_sql("A", "wf JOIN wend USING (window_id)", "window_id, start_idx, end_idx, label,"),
        SPLIT_SQL, STATS_SQL, LONG_SQL, BASE_SQL,
    ),
)
def flagship(spark, sf):
    """W1 + W2 + F1–F16: labelled training-variant features of every sliding window."""
    w = sliding(spark, sf, "A")
    label = windows.right_edge_label(F.col("last_gt_detection_win"), F.col("last_gt_fwhm"))
    return rounded(w.withColumn("label", label), "A", "window_id", "start_idx", "end_idx", "label")


@query(
    "f01_f15_null_readings",
    sql(feature_sql("A", extra="window_id,"), SPLIT_SQL, HOLES_SQL, BASE_SQL),
)
def null_readings(spark, sf):
    """Sliding features where every 97th reading is null: only whole windows have any."""
    holed = stream(spark, sf).withColumn("pressure", F.when(F.col("idx") % 97 != 0, F.col("pressure")))
    train = splits.position_split(holed).filter(F.col("split") == "train")
    w = ft.sliding_features(holed, ft.global_stats(train), "A", SIZE, STEP, chunk=chunk(spark, sf))
    return rounded(w, "A", "window_id")


@query(
    "f01_f15_variant_b",
    sql(
        feature_sql("B", "wf JOIN wr USING (window_id) JOIN ws USING (window_id)", "window_id,"),
        SPLIT_SQL, STATS_SQL, LONG_SQL, BASE_SQL, ROLL_SQL,
    ),
)
def variant_b(spark, sf):
    return rounded(sliding(spark, sf, "B"), "B", "window_id")


@query("f01_f15_variant_c", sql(feature_sql("C", extra="window_id,"), SPLIT_SQL, STATS_SQL, LONG_SQL, BASE_SQL))
def variant_c(spark, sf):
    return rounded(sliding(spark, sf, "C"), "C", "window_id")


@query("f01_f15_variant_d", sql(feature_sql("D", extra="window_id,"), SPLIT_SQL, STATS_SQL, LONG_SQL, BASE_SQL))
def variant_d(spark, sf):
    return rounded(sliding(spark, sf, "D"), "D", "window_id")


@query(
    "f16_global_stats",
    sql(f"SELECT {q6('g_mean', 'g_mean')}, {q6('g_std', 'g_std')} FROM gs", SPLIT_SQL, STATS_SQL),
)
def f16(spark, sf):
    return train_stats(spark, sf).select(r6("g_mean", "g_mean"), r6("g_std", "g_std"))


@query(
    "f17_hit_features",
    sql(
        f"SELECT window_id, {q6('avg(hits)', 'hits_mean')}, {q6('CAST(max(CASE WHEN pos_hit > 0 THEN 1 WHEN pos_hit IS NULL THEN NULL ELSE 0 END) AS DOUBLE)', 'hit_binary')}, "
        f"{q6('sum(hits) / 60', 'hit_ratio')} FROM wl GROUP BY 1",
        LONG_SQL,
    ),
)
def f17(spark, sf):
    rows = stream(spark, sf).select("idx", "autoencoder_window_hits", "autoencoder_positive_hit")
    return ft.sliding_hit_features(rows, SIZE, STEP, chunk(spark, sf)).select(
        "window_id",
        r6("autoencoder_window_hits_mean", "hits_mean"),
        r6("autoencoder_positive_hit_binary", "hit_binary"),
        r6("autoencoder_hit_ratio", "hit_ratio"),
    )


MA_SQL = """
ma AS (SELECT *, avg(pressure) OVER (ORDER BY idx ROWS 499 PRECEDING) AS ma500 FROM st),
dt AS (SELECT *, d - lag(d) OVER (ORDER BY idx) AS dd FROM (SELECT *, pressure - ma500 AS d FROM ma))"""


def ma500(spark, sf):
    return rolling_mean(stream(spark, sf).select("idx", "pressure"), "pressure", 500, "ma500", chunk(spark, sf))


@query("f29_moving_average_500", sql(f"SELECT idx, {q6('ma500', 'ma500')} FROM ma", MA_SQL))
def f29(spark, sf):
    return ma500(spark, sf).select("idx", r6("ma500", "ma500"))


def _f18_sql():
    f50, f49, f10, f9 = [f"(ORDER BY idx ROWS {k} PRECEDING)" for k in (49, 48, 9, 8)]
    parts = [
        f"avg(d) OVER {f50} AS mean_50", f"stddev_pop(d) OVER {f50} AS std_50", f"min(d) OVER {f50} AS min_50",
        f"max(d) OVER {f50} AS max_50", f"avg(dd) OVER {f49} AS diff_mean_50", f"stddev_pop(dd) OVER {f49} AS diff_std_50",
        f"avg(d) OVER {f10} AS mean_10", f"stddev_pop(d) OVER {f10} AS std_10",
        f"avg(dd) OVER {f9} AS diff_mean_10", f"stddev_pop(dd) OVER {f9} AS diff_std_10",
    ]
    names = [p.split(" AS ")[-1] for p in parts]
    return f"SELECT idx, {', '.join(q6(n, n) for n in names)} FROM (SELECT idx, {', '.join(parts)} FROM dt) WHERE idx >= 49"


@query("f18_detrended_features", sql(_f18_sql(), MA_SQL))
def f18(spark, sf):
    out = legacy.detrended_features(stream(spark, sf), chunk=chunk(spark, sf))
    return out.select("idx", *[r6(c, c) for c in legacy.DETRENDED])


@query(
    "f19_shape_features",
    sql(
        f"SELECT window_id, {', '.join(q6(c, c) for c in ('mean_pressure', 'std_pressure', 'min_pressure', 'max_pressure', 'pressure_range', 'rate_of_change_mean', 'rate_of_change_std', 'rate_of_change_max'))}, "
        "CAST(peak_count AS BIGINT) AS peak_count, CAST(valley_count AS BIGINT) AS valley_count FROM shp",
        LONG_SQL,
        """
g AS (SELECT *, lag(pressure) OVER w AS lp, lead(pressure) OVER w AS np, avg(pressure) OVER (PARTITION BY window_id) AS m
      FROM wl WINDOW w AS (PARTITION BY window_id ORDER BY pos)),
g2 AS (SELECT *, CASE WHEN lp IS NULL THEN np - pressure WHEN np IS NULL THEN pressure - lp ELSE (np - lp) / 2 END AS roc,
       CASE WHEN lp IS NULL OR pressure <> lp THEN 1 ELSE 0 END AS brk FROM g),
g3 AS (SELECT *, sum(brk) OVER (PARTITION BY window_id ORDER BY pos) AS grp FROM g2),
tops AS (SELECT window_id, grp, min(pos) AS p0, max(pos) AS p1, min(pressure) AS v, min(m) AS m FROM g3 GROUP BY 1, 2),
t2 AS (SELECT *, lag(v) OVER w AS lv, lead(v) OVER w AS nv FROM tops WINDOW w AS (PARTITION BY window_id ORDER BY grp)),
pk AS (SELECT window_id, sum(CASE WHEN v > lv AND v > nv AND v >= m THEN 1 ELSE 0 END) AS peak_count,
       sum(CASE WHEN v < lv AND v < nv AND v <= m THEN 1 ELSE 0 END) AS valley_count FROM t2 GROUP BY 1),
shp AS (SELECT window_id, avg(pressure) AS mean_pressure, stddev_pop(pressure) AS std_pressure, min(pressure) AS min_pressure,
        max(pressure) AS max_pressure, max(pressure) - min(pressure) AS pressure_range, avg(roc) AS rate_of_change_mean,
        stddev_pop(roc) AS rate_of_change_std, max(abs(roc)) AS rate_of_change_max,
        any_value(peak_count) AS peak_count, any_value(valley_count) AS valley_count FROM g2 JOIN pk USING (window_id) GROUP BY 1)""",
    ),
)
def f19(spark, sf):
    near = windows.window_arrays(stream(spark, sf), SIZE, STEP, chunk=chunk(spark, sf))
    out = legacy.shape_features(near.select(((F.col("end_idx") - (SIZE - 1)) / STEP).cast("long").alias("window_id"), "samples"))
    return out.select(
        "window_id",
        *[r6(c, c) for c in legacy.SHAPE if not c.endswith("_count")],
        big("peak_count", "peak_count"),
        big("valley_count", "valley_count"),
    )


SUB_SQL = """
fx AS (SELECT vortex, centre, greatest(centre - 150, 0) AS lo FROM cat WHERE centre >= 2),
fr AS (SELECT vortex, centre, lo, idx, idx - lo AS off, pressure, gt_detection_win FROM fx JOIN st ON idx BETWEEN lo AND centre - 1),
red AS (SELECT vortex, coalesce(min(CASE WHEN gt_detection_win THEN idx END), any_value(centre)) AS r0,
        coalesce(max(CASE WHEN gt_detection_win THEN idx END), any_value(centre)) AS r1 FROM fr GROUP BY 1),
sw AS (SELECT vortex, off // 20 AS sub, max(idx) AS right_idx, count(*) AS n, avg(pressure) AS m, stddev_pop(pressure) AS sd,
       max(CASE WHEN off % 20 = 0 THEN pressure END) AS p0, max(CASE WHEN off % 20 = 19 THEN pressure END) AS p1
       FROM fr GROUP BY 1, 2 HAVING count(*) = 20),
lt AS (SELECT vortex, idx, off, avg(pressure) OVER w AS lm, stddev_samp(pressure) OVER w AS ls FROM fr
       WINDOW w AS (PARTITION BY vortex ORDER BY idx))"""


@query(
    "w8_f20_f21_anchored_subwindows",
    sql(
        f"SELECT vortex, sub, right_idx, right_idx BETWEEN r0 AND r1 AS ml_label, {q6('p1 - p0', 'pressure_change')}, "
        f"{q6('(p0 - p1) / p0', 'drop_ratio')}, {q6('CASE WHEN sd > 0 THEN (p0 - p1) / sd ELSE 0.0 END', 'z_score')}, "
        "(p0 - p1) / p0 >= 0.08 AS scheme1, (CASE WHEN sd > 0 THEN (p0 - p1) / sd ELSE 0.0 END) >= 1.0 AS scheme2, "
        f"{q6('lm', 'long_term_mean')}, {q6('ls', 'long_term_std')}, {q6('m - lm', 'trend')} "
        "FROM sw JOIN red USING (vortex) JOIN lt ON lt.vortex = sw.vortex AND lt.idx = sw.right_idx",
        SUB_SQL,
    ),
)
def w8(spark, sf):
    out = anchored_subwindows(stream(spark, sf), catalogue(spark, sf))
    return out.select(
        "vortex", "sub", "right_idx", "ml_label", r6("pressure_change", "pressure_change"), r6("drop_ratio", "drop_ratio"),
        r6("z_score", "z_score"), "scheme1", "scheme2", r6("long_term_mean", "long_term_mean"),
        r6("long_term_std", "long_term_std"), r6("trend", "trend"),
    )


@query(
    "f21_c3_expanding_stats",
    sql(
        f"SELECT idx, {q6('avg(pressure) OVER w + 1e-9', 'long_term_mean')}, {q6('stddev_samp(pressure) OVER w', 'long_term_std')} "
        "FROM st WINDOW w AS (ORDER BY idx)"
    ),
)
def f21(spark, sf):
    out = legacy.expanding_stats(stream(spark, sf).select("idx", "pressure"), chunk=chunk(spark, sf))
    # The shift takes exact decimal ties off the rounding edge.
    return out.select("idx", r6(F.col("long_term_mean") + 1e-9, "long_term_mean"), r6("long_term_std", "long_term_std"))


ART_SQL = """
al AS (SELECT k AS end_excl, list(pressure ORDER BY idx) AS a FROM
        (SELECT unnest(range(60, (SELECT count(*) FROM st), 50)) AS k) JOIN st ON idx BETWEEN k - 60 AND k - 1 GROUP BY 1),
ad AS (SELECT *, list_transform(range(1, 60), lambda i: a[i + 1] - a[i]) AS d FROM al),
ax AS (SELECT *, list_min(d) AS md, list_position(d, list_min(d)) AS sh,
       coalesce(list_position(list_transform(d, lambda x: x < 0), true), 0) AS ini FROM ad),
af AS (SELECT end_excl, md AS min_slope,
       CASE WHEN ini > 0 THEN a[60] - a[ini] ELSE 0.0 END AS total_drop_after_initial,
       (a[least(sh + 5, 60)] - a[sh]) / (least(sh + 5, 60) - sh) AS avg_slope_after_sharpest,
       a[60] - a[sh] AS total_drop_after_sharpest,
       coalesce(nullif(coalesce(list_position(list_transform(d[sh + 1:], lambda x: x < 0), false), 0), 0) - 1, 59 - sh) AS consecutive_negative_slopes,
       a[60] - a[1] AS total_drop, list_median(a) - list_avg(a) AS normalized_median_pressure,
       list_stddev_pop(a) AS normalized_pressure_std,
       list_stddev_pop(d) / (list_stddev_pop(a) + 1e-8) AS normalized_slope_std FROM ax)"""
ARTEFACT_RULE = (
    "(min_slope < -0.35 AND avg_slope_after_sharpest > -0.1) OR total_drop_after_initial < 0.1 "
    "OR total_drop_after_sharpest < -0.75"
)


@query(
    "w10_f22_f23_artefacts",
    sql(
        f"SELECT end_excl, {', '.join(q6(c, c) for c in legacy.ARTEFACT if c != 'consecutive_negative_slopes')}, "
        f"CAST(consecutive_negative_slopes AS BIGINT) AS consecutive_negative_slopes, {ARTEFACT_RULE} AS is_artefact FROM af",
        ART_SQL,
    ),
)
def w10(spark, sf):
    """W10 + F22 + F23: artefact scan over end-exclusive windows, step 50."""
    near = legacy.artefact_windows(stream(spark, sf), SIZE, 50, chunk=chunk(spark, sf))
    out = legacy.artefact_features(near)
    return out.select(
        "end_excl",
        *[r6(c, c) for c in legacy.ARTEFACT if c != "consecutive_negative_slopes"],
        big("consecutive_negative_slopes", "consecutive_negative_slopes"),
        legacy.artefact_rule().alias("is_artefact"),
    )


@query(
    "f24_rate_of_change",
    sql(
        "SELECT idx, "
        + ", ".join(
            q6(
                f"coalesce(CASE WHEN count(*) OVER w{n} > 1 THEN regr_slope(pressure, idx) OVER w{n} END, 0.0)", f"roc_{n}"
            )
            for n in (5, 11, 21)
        )
        + " FROM st WINDOW "
        + ", ".join(f"w{n} AS (ORDER BY idx ROWS BETWEEN {n // 2} PRECEDING AND {n // 2} FOLLOWING)" for n in (5, 11, 21))
    ),
)
def f24(spark, sf):
    out = rolling(
        stream(spark, sf).select("idx", "pressure"),
        {f"roc_{n}": windows.centred_slope("pressure", n) for n in (5, 11, 21)},
        10,
        10,
        chunk(spark, sf),
    )
    return out.select("idx", *[r6(f"roc_{n}", f"roc_{n}") for n in (5, 11, 21)])


def _savgol_sql(n: int) -> str:
    """Parabola of the n rows around the nearest row that has h on both sides, by the normal equations."""
    h = n // 2
    s0, s2, s4 = n, h * (h + 1) * n // 3, h * (h + 1) * n * (3 * h * h + 3 * h - 1) // 15
    det = s0 * s4 - s2 * s2
    fit = f"({s4} * s_y - {s2} * s_xxy) / {det}.0 + s_xy / {s2}.0 * (a.idx - c) + ({s0} * s_xxy - {s2} * s_y) / {det}.0 * (a.idx - c) * (a.idx - c)"
    return (
        f"sg{n} AS (SELECT a.idx AS idx, {q6(fit, f'smooth_{n}')} FROM (SELECT idx, greatest({h}, least(idx, (SELECT max(idx) FROM st) - {h})) AS c FROM st) a JOIN "
        f"(SELECT m.idx AS m, sum(b.pressure) AS s_y, sum((b.idx - m.idx) * b.pressure) AS s_xy, sum((b.idx - m.idx) * (b.idx - m.idx) * b.pressure) AS s_xxy "
        f"FROM st m, (SELECT unnest(range({-h}, {h + 1})) AS o) JOIN st b ON b.idx = m.idx + o GROUP BY m.idx) ON m = c)"
    )


@query(
    "f25_savitzky_golay",
    sql("SELECT idx, smooth_5, smooth_11, smooth_21 FROM sg5 JOIN sg11 USING (idx) JOIN sg21 USING (idx)", *[_savgol_sql(n) for n in (5, 11, 21)]),
)
def f25(spark, sf):
    out = legacy.savgol(stream(spark, sf).select("idx", "pressure"), (5, 11, 21), chunk(spark, sf))
    return out.select("idx", *[r6(f"smooth_{n}", f"smooth_{n}") for n in (5, 11, 21)])


@query(
    "f26_f27_f28_sequence_features",
    sql(
        f"SELECT idx, {q6('det', 'detrended')}, {q6('acc', 'acceleration')}, {q6('coalesce(CASE WHEN n >= 3 THEN sk END, 0.0)', 'roll_skew')}, "
        f"{q6('coalesce(CASE WHEN n >= 4 THEN ku END, 0.0)', 'roll_kurt')} FROM ("
        "SELECT idx, pressure - avg(pressure) OVER (ORDER BY idx ROWS 59 PRECEDING) AS det, "
        "pressure - 2 * coalesce(lag(pressure, 1) OVER o, first_value(pressure) OVER o) + coalesce(lag(pressure, 2) OVER o, first_value(pressure) OVER o) AS acc, "
        "skewness(pressure) OVER f AS sk, kurtosis(pressure) OVER f AS ku, count(*) OVER f AS n FROM st "
        "WINDOW o AS (ORDER BY idx), f AS (ORDER BY idx ROWS 19 PRECEDING))"
    ),
)
def f26(spark, sf):
    out = legacy.sequence_features(stream(spark, sf).select("idx", "pressure"), chunk(spark, sf))
    return out.select("idx", *[r6(c, c) for c in ("detrended", "acceleration", "roll_skew", "roll_kurt")])


@query("f30_normalised", sql(f"SELECT idx, {q6('(pressure - g_mean) / g_std', 'z')} FROM st, gs", SPLIT_SQL, STATS_SQL))
def f30(spark, sf):
    out = ft.with_stats(stream(spark, sf), train_stats(spark, sf))
    return out.select("idx", r6((F.col("pressure") - F.col("g_mean")) / F.col("g_std"), "z"))


@query(
    "f31_window_summary",
    sql(
        "SELECT window_id, label, " + ", ".join(f"round({a}(pressure), 4) + 0.0 AS p_{b}" for a, b in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")))
        + ", count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM wl GROUP BY 1, 2",
        LONG_SQL,
    ),
)
def f31(spark, sf):
    i, v = F.col("idx"), F.col("pressure")
    wanted = {"p_mean": panes.mean(v), "p_std": panes.sample_std(v), "p_min": panes.low(v), "p_max": panes.high(v)}
    wanted |= {"n": panes.count(), "first_idx": panes.low(i), "last_idx": panes.high(i), "d": panes.last(F.col("gt_detection_win")), "f": panes.last(F.col("gt_fwhm"))}
    out = panes.window_summary(stream(spark, sf).select("idx", "pressure", "gt_detection_win", "gt_fwhm"), SIZE, STEP, wanted, chunk(spark, sf))
    rounded = [F.round(c, 4).alias(c) for c in ("p_mean", "p_std", "p_min", "p_max")]
    return out.select("window_id", windows.right_edge_label(F.col("d"), F.col("f")).alias("label"), *rounded, "n", "first_idx", "last_idx")


@query(
    "t24_post_filter",
    sql(
        "SELECT end_excl, min_slope >= -0.35 AND total_drop_after_initial < 0.1 AND avg_slope_after_sharpest > -0.3 AS kept FROM af",
        ART_SQL,
    ),
)
def t24(spark, sf):
    near = legacy.artefact_windows(stream(spark, sf), SIZE, 50, chunk=chunk(spark, sf))
    return legacy.artefact_features(near).select("end_excl", legacy.post_filter_keeps().alias("kept"))


@query(
    "t24_filtered_predictions",
    sql(
        "SELECT window_id, p >= 0.5 AS predicted, p >= 0.5 AND coalesce(min_slope >= -0.35 AND total_drop_after_initial < 0.1 AND avg_slope_after_sharpest > -0.3, true) AS kept "
        "FROM wend LEFT JOIN af ON end_excl = end_idx + 1",
        ART_SQL.replace("(SELECT count(*) FROM st), 50)", "(SELECT count(*) FROM st), 10)"),
    ),
)
def t24b(spark, sf):
    """Positive predictions that pass the shape tests of their own window; the rest stay negative."""
    shapes = legacy.artefact_features(legacy.artefact_windows(stream(spark, sf), SIZE, STEP, chunk=chunk(spark, sf)))
    keeps = shapes.select((F.col("end_excl") - 1).alias("end_idx"), legacy.post_filter_keeps().alias("_keeps"))
    scored_ = wends(spark, sf).select("window_id", "end_idx", (F.col("p") >= 0.5).alias("predicted"))
    kept = F.col("predicted") & F.coalesce("_keeps", F.lit(True))
    return scored_.join(keeps, "end_idx", "left").select("window_id", "predicted", kept.alias("kept"))


@query(
    "w13_padding",
    sql(
        f"SELECT blk, {i8('len(a) + (60 - len(a))', 'n')}, {q6('(list_sum(a) + (60 - len(a)) * a[-1])', 'total')} FROM "
        "(SELECT idx // 60 AS blk, list(pressure ORDER BY idx) AS a FROM st GROUP BY 1)"
    ),
)
def w13(spark, sf):
    """W9 + W13: tumbling blocks, the short last one padded with its final value."""
    blocks = windows.nested_windows(windows.tumbling(stream(spark, sf), 60), ["window_id"], ["pressure"])
    padded = windows.pad_last(F.col("window_data.pressure"), 60)
    return blocks.select(
        F.col("window_id").alias("blk"), big(F.size(padded), "n"), r6(arrays.array_sum(padded), "total")
    )
