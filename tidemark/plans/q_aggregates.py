"""Aggregation, set-operation and audit queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators import audit, features as ft, metrics, runs, setops, splits, windows
from tidemark.operators.event_metrics import in_event
from tidemark.operators.index import exact_percentiles, in_chunk, rolling
from tidemark.plans.base import (
    SIZE, STEP, big, chunk, i8, q6, query, r6, raw_stream, scored, sql, stored, stream, wends,
)
from tidemark.plans.q_features import BASE_SQL, LONG_SQL, SPLIT_SQL, STATS_SQL, feature_sql, sliding
from tidemark.plans.q_joins import TRUE_RUNS, runs_cte
from tidemark.plans.q_windowing import (
    BAL_LONG, DET_RUNS, FREE_SQL, NEG_SQL, POS_SQL, ZONE_SQL, balanced,
)
from tidemark.session import materialise

A = ft.features_of("A")
BAL = [DET_RUNS, POS_SQL, ZONE_SQL, FREE_SQL, NEG_SQL]


def window_table(spark, sf):
    """Precomputed sliding features with label, integer class and split; stored once per session."""

    def build():
        w = sliding(spark, sf, "A")
        label = windows.right_edge_label(F.col("last_gt_detection_win"), F.col("last_gt_fwhm"))
        w = w.withColumn("label", label).withColumn("y", (label == "True").cast("int"))
        rows = splits.row_count(stream(spark, sf))
        w = splits.position_split(w, keep_gaps=True, by="end_idx", rows=rows)
        return materialise(w.drop("last_gt_detection_win", "last_gt_fwhm"))

    return stored(spark, sf, "features_a", build)


def labelled_windows(spark, sf):
    return window_table(spark, sf).filter(F.col("label") != "Omit")


RAW_A = feature_sql("A", "wf JOIN wend USING (window_id)", "window_id, start_idx, end_idx, label,").replace("round(", "(").replace(", 6) + 0.0 AS", ") AS")
WSPLIT = """
n1 AS (SELECT count(*) AS n FROM ev),
fw AS (SELECT *, CASE WHEN label = 'True' THEN 1 ELSE 0 END AS y,
  CASE WHEN end_idx < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
    WHEN end_idx >= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.035 AS DOUBLE))) AND end_idx < floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.035 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
    WHEN end_idx >= floor(n * (CAST(0.7 AS DOUBLE) + 2 * CAST(0.035 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'test' END AS split FROM fa, n1),
fl AS (SELECT * FROM fw WHERE label <> 'Omit')"""
FEAT = [SPLIT_SQL, STATS_SQL, LONG_SQL, BASE_SQL, f"fa AS ({RAW_A})", WSPLIT]


@query(
    "a1_class_distribution",
    sql(f"SELECT label, count(*) AS n, {q6('count(*) * 100.0 / (SELECT count(*) FROM wend)', 'percent')} FROM wend GROUP BY 1"),
)
def a1(spark, sf):
    label = windows.right_edge_label(F.col("gt_detection_win"), F.col("gt_fwhm"))
    out = ag.class_distribution(wends(spark, sf).select(label.alias("label")), "label")
    return out.select("label", "n", r6("percent", "percent"))


SPLIT_Y = """
wy AS (SELECT sc.*, CASE WHEN end_idx < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
    WHEN end_idx >= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.035 AS DOUBLE))) AND end_idx < floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.035 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
    WHEN end_idx >= floor(n * (CAST(0.7 AS DOUBLE) + 2 * CAST(0.035 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'test' END AS split
  FROM sc, (SELECT count(*) AS n FROM ev)),
pri AS (SELECT split, count(*) AS total, CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives, sum(y) / count(*) AS pp, sum(1 - y) / count(*) AS pn
  FROM wy WHERE split IS NOT NULL GROUP BY 1)"""


def split_scores(spark, sf):
    return splits.position_split(scored(spark, sf), by="end_idx", rows=splits.row_count(stream(spark, sf)))


@query(
    "a2_class_priors",
    sql(f"SELECT split, total, positives, negatives, {q6('pp', 'prior_positive')}, {q6('pn', 'prior_negative')}, {q6('negatives / positives', 'ratio_neg_to_pos')} FROM pri", SPLIT_Y),
)
def a2(spark, sf):
    out = ag.class_priors(split_scores(spark, sf), "split")
    return out.select(
        "split", "total", "positives", "negatives", r6("prior_positive", "prior_positive"),
        r6("prior_negative", "prior_negative"), r6("ratio_neg_to_pos", "ratio_neg_to_pos"),
    )


def _scaled(w0, w1):
    return f"({w0}) * 2 / (({w0}) + ({w1}))", f"({w1}) * 2 / (({w0}) + ({w1}))"


WEIGHTS = {
    "inverse_freq": _scaled("1 / (2 * pn)", "1 / (2 * pp)"),
    "balanced": _scaled("1 / (2 * pn)", "1 / (2 * pp)"),
    "sqrt": _scaled("sqrt(1 / (2 * pn))", "sqrt(1 / (2 * pp))"),
    "prior_adjusted": _scaled("CAST(1 AS DOUBLE)", "pn / pp"),
    "n_over_2nc": ("total / (2 * negatives)", "total / (2 * positives)"),
    "neg_over_pos": ("CAST(1 AS DOUBLE)", "negatives / positives"),
    "sqrt_total": ("sqrt(total / (2 * negatives))", "sqrt(total / (2 * positives))"),
}


@query(
    "a3_class_weights",
    sql(" UNION ALL ".join(f"SELECT split, '{k}' AS method, {q6(a, 'w0')}, {q6(b, 'w1')} FROM pri" for k, (a, b) in WEIGHTS.items()), SPLIT_Y),
)
def a3(spark, sf):
    """A3 + A3b."""
    w = ag.class_weights(ag.class_priors(split_scores(spark, sf), "split"))
    return w.select("split", "method", r6("w0", "w0"), r6("w1", "w1"))


@query(
    "a4_position_profile",
    sql(
        f"SELECT pos, {q6('avg(pressure) FILTER (WHERE label = 1)', 'mean_1')}, {q6('stddev_samp(pressure) FILTER (WHERE label = 1)', 'std_1')}, "
        f"{q6('avg(pressure) FILTER (WHERE label = 0)', 'mean_0')}, {q6('stddev_samp(pressure) FILTER (WHERE label = 0)', 'std_0')}, "
        f"{q6('avg(pressure) FILTER (WHERE label = 1) - avg(pressure) FILTER (WHERE label = 0)', 'difference')} FROM wl JOIN bal USING (window_id) GROUP BY 1",
        *BAL,
        BAL_LONG,
    ),
)
def a4(spark, sf):
    rows = windows.windows_from(stream(spark, sf).select("idx", "pressure"), balanced(spark, sf), SIZE)
    out = ag.position_profile(rows)
    return out.select("pos", *[r6(c, c) for c in ("mean_1", "std_1", "mean_0", "std_0", "difference")])


def _sep_sql(f):
    one, zero = f"CASE WHEN y = 1 THEN \"{f}\" END", f"CASE WHEN y = 0 THEN \"{f}\" END"
    cols = []
    for tag, e in (("1", one), ("0", zero)):
        cols += [q6(f"avg({e})", f"mean_{tag}"), q6(f"stddev_samp({e})", f"std_{tag}"), q6(f"min({e})", f"min_{tag}"), q6(f"max({e})", f"max_{tag}")]
    sep = f"abs(avg({one}) - avg({zero})) / (stddev_samp({one}) + stddev_samp({zero}))"
    return f"SELECT '{f}' AS feature, {', '.join(cols)}, {q6(sep, 'separation')} FROM fl"


@query("a5_feature_separation", sql(" UNION ALL ".join(_sep_sql(f) for f in A), *FEAT))
def a5(spark, sf):
    out = ag.feature_separation(labelled_windows(spark, sf), A)
    return out.select("feature", *[r6(c, c) for c in out.columns if c != "feature"])


SEP_CTE = "sepa AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, abs(avg(CASE WHEN y = 1 THEN \"{f}\" END) - avg(CASE WHEN y = 0 THEN \"{f}\" END)) / "
    f"(stddev_samp(CASE WHEN y = 1 THEN \"{f}\" END) + stddev_samp(CASE WHEN y = 0 THEN \"{f}\" END)) AS separation FROM fl"
    for f in A
) + ")"


@query(
    "k3_g8_feature_ranking",
    sql(
        f"SELECT feature, place, {q6('share', 'cumulative_share')} FROM (SELECT feature, row_number() OVER (ORDER BY separation DESC, feature) AS place, "
        "sum(separation) OVER (ORDER BY separation DESC, feature) / sum(separation) OVER () AS share FROM sepa) WHERE place <= 10",
        *FEAT,
        SEP_CTE,
    ),
)
def k3(spark, sf):
    """K3 + G8: the ten most separating features with their cumulative share."""
    from tidemark.operators.ml import ranked_share

    out = ranked_share(ag.feature_separation(labelled_windows(spark, sf), A).select("feature", "separation"), "separation")
    return out.filter("place <= 10").select("feature", "place", r6("cumulative_share", "cumulative_share"))


@query(
    "a6_a7_two_sample",
    sql(
        f"SELECT n1, n0, dof, t, cohens_d, round(1 - 2 * abs(t0) / 4000 / 3 * exp(lgamma((dof + 1) / 2.0) - lgamma(dof / 2.0)) / sqrt(dof * pi()) * list_sum(list_transform(range(0, 4001), "
        "lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(1 + (i * t0 / 4000) * (i * t0 / 4000) / dof, -(dof + 1) / 2.0))), 6) + 0.0 AS p_value "
        f"FROM (SELECT n1, n0, n1 + n0 - 2 AS dof, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0)) AS t0, {q6('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1 / n1 + 1 / n0))', 't')}, "
        f"{q6('abs(m1 - m0) / sqrt((v1 + v0) / 2)', 'cohens_d')} FROM (SELECT count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0, "
        "avg(overall_slope) FILTER (WHERE y = 1) AS m1, avg(overall_slope) FILTER (WHERE y = 0) AS m0, var_samp(overall_slope) FILTER (WHERE y = 1) AS v1, "
        "var_samp(overall_slope) FILTER (WHERE y = 0) AS v0 FROM fl))",
        *FEAT,
    ),
)
def a6(spark, sf):
    out = ag.two_sample(labelled_windows(spark, sf), "overall_slope")
    p = F.pandas_udf(ag.student_p, "double")(F.col("t"), F.col("dof").cast("double"))  # one row
    return out.select("n1", "n0", "dof", r6("t", "t"), r6("cohens_d", "cohens_d"), r6(p, "p_value"))


PAIRS = list(combinations(A, 2))


@query(
    "a8_correlation_matrix",
    sql(
        f"SELECT s.f1, s.f2, {q6('s.r', 'r')}, abs(s.r) > 0.95 AS high FROM (SELECT unnest([" + ", ".join(f"{{'f1': '{a}', 'f2': '{b}', 'r': corr(\"{a}\", \"{b}\")}}" for a, b in PAIRS) + "]) AS s FROM fl)",
        *FEAT,
    ),
)
def a8(spark, sf):
    out = ag.correlation_matrix(labelled_windows(spark, sf), A)
    return out.select("f1", "f2", r6("r", "r"), (F.abs("r") > 0.95).alias("high"))


QS = [0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 0.9999]


@query(
    "a9_percentiles",
    sql(
        f"SELECT y, q, {q6('v', 'p')} FROM (SELECT CAST(y AS VARCHAR) AS y, unnest({QS}::DOUBLE[]) AS q, unnest(quantile_cont(p, {QS})) AS v FROM sc GROUP BY 1 "
        f"UNION ALL SELECT 'all', unnest({QS}::DOUBLE[]), unnest(quantile_cont(p, {QS})) FROM sc)"
    ),
)
def a9(spark, sf):
    """Exact percentiles of the scores, overall and per class, without one task holding them all."""
    s = scored(spark, sf).select(F.explode(F.array(F.lit("all"), F.col("y").cast("string"))).alias("y"), "p")
    return exact_percentiles(s, "p", QS, by="y").select("y", "q", r6("p", "p"))


@query(
    "a10_flag_agreement",
    sql(
        f"SELECT CAST(b AS BIGINT) AS both, CAST(a AS BIGINT) AS only_a, CAST(g AS BIGINT) AS only_b, CAST(n AS BIGINT) AS neither, {q6('b / (b + a)', 'precision')}, {q6('b / (b + g)', 'recall')} FROM ("
        "SELECT sum(CASE WHEN pos_hit = 1 AND gt_detection_win THEN 1 ELSE 0 END) AS b, sum(CASE WHEN pos_hit = 1 AND NOT gt_detection_win THEN 1 ELSE 0 END) AS a, "
        "sum(CASE WHEN pos_hit = 0 AND gt_detection_win THEN 1 ELSE 0 END) AS g, sum(CASE WHEN pos_hit = 0 AND NOT gt_detection_win THEN 1 ELSE 0 END) AS n FROM st)"
    ),
)
def a10(spark, sf):
    out = ag.agreement(stream(spark, sf), F.col("autoencoder_positive_hit") == 1, F.col("gt_detection_win"))
    return out.select("both", "only_a", "only_b", "neither", r6("precision", "precision"), r6("recall", "recall"))


@query(
    "a11_by_sol",
    sql(
        f"SELECT {q6('avg(c)', 'mean_per_sol')}, {q6('median(c)', 'median_per_sol')}, max(c) AS max_per_sol, count(*) AS sols_with_events, "
        f"(SELECT max(sol) - min(sol) + 1 FROM st) AS total_sols, {q6('(SELECT count(*) / ((max(sol) - min(sol) + 1) * 86400) FROM st)', 'coverage')} "
        "FROM (SELECT sol, count(*) AS c FROM st WHERE gt_detection_win GROUP BY 1)"
    ),
)
def a11(spark, sf):
    out = ag.by_sol(stream(spark, sf), "gt_detection_win")
    return out.select(
        r6("mean_per_sol", "mean_per_sol"), r6("median_per_sol", "median_per_sol"), "max_per_sol", "sols_with_events",
        "total_sols", r6("coverage", "coverage"),
    )


@query(
    "a12_event_durations",
    sql(f"SELECT count(*) AS events, {q6('avg(e - s + 1)', 'mean_length')}, min(e - s + 1) AS min_length, max(e - s + 1) AS max_length FROM fr", runs_cte("fr", "gt_fwhm")),
)
def a12(spark, sf):
    out = ag.run_lengths(runs.runs(stream(spark, sf), F.col("gt_fwhm"), chunk(spark, sf)))
    return out.select("events", r6("mean_length", "mean_length"), "min_length", "max_length")


@query(
    "a13_signal_to_noise",
    sql(
        f"SELECT feature, {q6('avg(abs(value)) FILTER (WHERE gt_fwhm)', 'inside_mean')}, {q6('avg(abs(value)) FILTER (WHERE NOT gt_fwhm)', 'outside_mean')}, "
        f"{q6('stddev_pop(abs(value)) FILTER (WHERE NOT gt_fwhm)', 'noise_std')}, {q6('avg(abs(value)) FILTER (WHERE gt_fwhm) / avg(abs(value)) FILTER (WHERE NOT gt_fwhm)', 'snr')} FROM m GROUP BY 1",
        "d AS (SELECT idx, gt_fwhm, pressure - lag(pressure) OVER (ORDER BY idx) AS simple, regr_slope(pressure, idx) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS roc_5, "
        "regr_slope(pressure, idx) OVER (ORDER BY idx ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS roc_11 FROM st)",
        "m AS (SELECT 'simple' AS feature, gt_fwhm, simple AS value FROM d WHERE simple IS NOT NULL UNION ALL SELECT 'roc_5', gt_fwhm, roc_5 FROM d UNION ALL SELECT 'roc_11', gt_fwhm, roc_11 FROM d)",
    ),
)
def a13(spark, sf):
    m = rolling(
        stream(spark, sf).select("idx", "pressure", "gt_fwhm"),
        {
            "simple": F.col("pressure") - F.lag("pressure").over(in_chunk()),
            "roc_5": windows.centred_slope("pressure", 5),
            "roc_11": windows.centred_slope("pressure", 11),
        },
        5,
        5,
        chunk(spark, sf),
    )
    out = ag.signal_to_noise(m, ["simple", "roc_5", "roc_11"], "gt_fwhm")
    return out.select("feature", *[r6(c, c) for c in ("inside_mean", "outside_mean", "noise_std", "snr")])


@query(
    "a14_scores_by_region",
    sql(
        f"SELECT region, count(*) AS n, {q6('avg(p)', 'mean_score')}, {q6('max(p)', 'max_score')}, {q6('min(p)', 'min_score')}, "
        + ", ".join(q6(f"avg(CASE WHEN p >= {t} THEN 1.0 ELSE 0.0 END)", f"share_{str(t)[2:]}") for t in (0.45, 0.5, 0.9))
        + " FROM (SELECT 'gt_fwhm' AS region, p FROM st WHERE gt_fwhm UNION ALL SELECT 'gt_detection_win', p FROM st WHERE gt_detection_win "
        "UNION ALL SELECT 'gt_4xfwhm', p FROM st WHERE gt_4xfwhm) GROUP BY 1"
    ),
)
def a14(spark, sf):
    out = ag.scores_by_region(stream(spark, sf), "p", ["gt_fwhm", "gt_detection_win", "gt_4xfwhm"])
    return out.select("region", "n", *[r6(c, c) for c in out.columns if c not in ("region", "n")])


@query(
    "a15_window_rollup",
    sql(
        "SELECT CAST(y AS BIGINT) AS y, count(*) AS windows, CAST(sum(CASE WHEN (y = 1 AND p > 0.5) OR (y = 0 AND p <= 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS correct, "
        "CAST(sum(CASE WHEN d THEN 1 ELSE 0 END) AS BIGINT) AS with_detection, CAST(sum(CASE WHEN f THEN 1 ELSE 0 END) AS BIGINT) AS with_fwhm, CAST(sum(CASE WHEN d AND f THEN 1 ELSE 0 END) AS BIGINT) AS with_both FROM sc JOIN "
        "(SELECT w.window_id, bool_or(s.gt_detection_win) AS d, bool_or(s.gt_fwhm) AS f FROM wend w, (SELECT unnest(range(60)) AS o) JOIN st s ON s.idx = w.start_idx + o GROUP BY 1) USING (window_id) GROUP BY 1"
    ),
)
def a15(spark, sf):
    rows = stream(spark, sf).select("idx", "gt_detection_win", "gt_fwhm")
    w = ag.window_rollup(rows, scored(spark, sf).select("window_id", "p", "y"), SIZE, STEP, chunk(spark, sf))
    right = ((F.col("y") == 1) & (F.col("p") > 0.5)) | ((F.col("y") == 0) & (F.col("p") <= 0.5))
    d, f = F.col("has_detection"), F.col("has_fwhm")
    return w.groupBy(big("y", "y")).agg(
        F.count(F.lit(1)).alias("windows"), big(F.sum(right.cast("int")), "correct"),
        big(F.sum(d.cast("int")), "with_detection"), big(F.sum(f.cast("int")), "with_fwhm"),
        big(F.sum((d & f).cast("int")), "with_both"),
    )


@query(
    "a16_event_profiles",
    sql(
        f"SELECT s AS start_idx, {q6('max(pressure) - min(pressure)', 'pressure_range')}, {q6('arg_min(pressure, idx) - min(pressure)', 'pressure_drop')}, count(*) AS duration, "
        f"{q6('avg(p)', 'mean_score')}, {q6('max(p)', 'max_score')} FROM tr JOIN st ON idx BETWEEN s AND e + 1 GROUP BY 1",
        TRUE_RUNS,
    ),
)
def a16(spark, sf):
    out = ag.event_profiles(stream(spark, sf), chunk(spark, sf))
    return out.select("start_idx", r6("pressure_range", "pressure_range"), r6("pressure_drop", "pressure_drop"), "duration",
                      r6("mean_score", "mean_score"), r6("max_score", "max_score"))


@query(
    "a17_mean_patterns",
    sql(
        f"SELECT kind, b.idx - a.idx AS rel_pos, {q6('avg(b.pressure)', 'mean_p')}, {q6('stddev_pop(b.pressure)', 'std_p')}, {q6('avg(b.step)', 'mean_step')}, count(*) AS n FROM "
        "(SELECT idx, CASE WHEN gt_fwhm OR gt_detection_win THEN 'hit' ELSE 'false_alarm' END AS kind FROM st WHERE p >= 0.8) a "
        "JOIN (SELECT idx, pressure, pressure - lag(pressure) OVER (ORDER BY idx) AS step FROM st) b ON b.idx BETWEEN a.idx - 60 AND a.idx + 60 GROUP BY 1, 2"
    ),
)
def a17(spark, sf):
    """Mean pattern ±60 samples around each positive point, hit against false alarm."""
    s = stream(spark, sf)
    kind = F.when(F.col("p") >= 0.8, F.when(in_event(), "hit").otherwise("false_alarm"))
    out = ag.mean_patterns(s, kind, 60, chunk=chunk(spark, sf))
    return out.select("kind", "rel_pos", r6("mean_p", "mean_p"), r6("std_p", "std_p"), r6("mean_step", "mean_step"), "n")


@query(
    "a18_clock_gaps",
    sql("SELECT gap, count(*) AS n FROM (SELECT sclk - lag(sclk) OVER (ORDER BY idx) AS gap FROM ev) WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap LIMIT 5"),
)
def a18(spark, sf):
    return ag.clock_gaps(raw_stream(spark, sf), 5, chunk(spark, sf))


def _hist_sql(where: str, y: str) -> str:
    return (
        f"SELECT '{y}' AS cls, bin, n, {q6('sum(n) OVER (ORDER BY bin) / sum(n) OVER ()', 'cdf')} FROM (SELECT least(CAST(floor((p - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS bin, count(*) AS n "
        f"FROM sc, rg WHERE {where} GROUP BY 1)"
    )


@query(
    "a19_score_histogram",
    sql(f"{_hist_sql('y = 0', '0')} UNION ALL {_hist_sql('y = 1', '1')}", "rg AS (SELECT min(p) AS lo, max(p) AS hi FROM sc)"),
)
def a19(spark, sf):
    s = scored(spark, sf).select("p", F.col("y").cast("string").alias("cls"))
    out = metrics.histogram(s, "p", 30, by=["cls"])
    return out.select("cls", "bin", "n", r6("cdf", "cdf"))


# --- set operations ---------------------------------------------------------------------------


@query(
    "u1_union_all",
    sql("SELECT split, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx, count(val_only) AS val_only FROM (SELECT *, CASE WHEN split = 'val' THEN 1 END AS val_only FROM sp WHERE split IS NOT NULL) GROUP BY 1", SPLIT_SQL),
)
def u1(spark, sf):
    s = splits.position_split(stream(spark, sf)).select("idx", "split")
    parts = [s.filter(F.col("split") == k) for k in ("train", "val", "test")]
    parts[1] = parts[1].withColumn("val_only", F.lit(1))
    return setops.union_all(*parts).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("val_only").alias("val_only")
    )


@query(
    "u2_split_overlaps",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}_{b}' AS pair, count(*) AS shared FROM (SELECT sclk FROM sp WHERE split = '{a}' INTERSECT SELECT sclk FROM sp WHERE split = '{b}')"
            for a, b in combinations(("train", "val", "test"), 2)
        ),
        SPLIT_SQL,
    ),
)
def u2(spark, sf):
    return setops.split_overlaps(splits.position_split(stream(spark, sf)))


@query("u2_shared_clocks", sql("SELECT sclk FROM ev WHERE channel % 2 = 0 INTERSECT SELECT sclk FROM ev WHERE channel % 3 = 0"))
def u2b(spark, sf):
    s = stream(spark, sf)
    return setops.shared_clocks(s.filter("channel % 2 = 0"), s.filter("channel % 3 = 0"))


def _cmp_side(cond: str, ncol: int) -> str:
    return (
        f"SELECT CAST(count(*) AS DOUBLE) AS rows, CAST({ncol} AS DOUBLE) AS columns, CAST(min(sclk) AS DOUBLE) AS min_clock, CAST(max(sclk) AS DOUBLE) AS max_clock, "
        "CAST(max(sol) - min(sol) AS DOUBLE) AS sols, CAST(sum(CASE WHEN gt_detection_win THEN 1 ELSE 0 END) AS DOUBLE) AS positives, "
        f"avg(CASE WHEN gt_detection_win THEN 1.0 ELSE 0.0 END) AS positive_rate, avg(pressure) AS mean_pressure, stddev_samp(pressure) AS std_pressure FROM st WHERE {cond}"
    )


CMP = ["rows", "columns", "min_clock", "max_clock", "sols", "positives", "positive_rate", "mean_pressure", "std_pressure"]


@query(
    "u4_u3_compare_datasets",
    sql(
        f"SELECT metric, {q6('l', 'left_value')}, {q6('r', 'right_value')} FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS metric, a.{c} AS l, b.{c} AS r FROM a, b" for c in CMP)
        + " UNION ALL SELECT 'shared_clocks', CAST(count(*) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM (SELECT sclk FROM st WHERE event_type <> 'view' INTERSECT SELECT sclk FROM st WHERE channel % 2 = 0)"
        " UNION ALL SELECT 'own_clocks', (SELECT CAST(count(*) AS DOUBLE) FROM (SELECT sclk FROM st WHERE event_type <> 'view' EXCEPT SELECT sclk FROM st WHERE channel % 2 = 0)), "
        "(SELECT CAST(count(*) AS DOUBLE) FROM (SELECT sclk FROM st WHERE channel % 2 = 0 EXCEPT SELECT sclk FROM st WHERE event_type <> 'view'))"
        " UNION ALL SELECT 'common_columns', 8, 8 UNION ALL SELECT 'only_columns', 5, 0)",
        f"a AS ({_cmp_side(chr(101) + 'vent_type <> ' + chr(39) + 'view' + chr(39), 13)})",
        f"b AS ({_cmp_side('channel % 2 = 0', 8)})",
    ),
)
def u4(spark, sf):
    """U3 + U4: extended rows against a plain subset of channels."""
    s = stream(spark, sf)
    left = s.filter(F.col("event_type") != "view")
    right = s.filter("channel % 2 = 0").select("idx", "sclk", "sol", "pressure", "p", "gt_fwhm", "gt_detection_win", "gt_4xfwhm")
    diff = setops.schema_diff(left, right)
    names = [("common_columns", len(diff["common"]), len(diff["common"])), ("only_columns", len(diff["only_left"]), len(diff["only_right"]))]
    cells = [F.struct(F.lit(m).alias("metric"), F.lit(float(a)).alias("left_value"), F.lit(float(b)).alias("right_value")) for m, a, b in names]
    extra = spark.range(1).select(F.inline(F.array(*cells)))
    out = setops.compare_datasets(left, right).unionByName(extra)
    return out.select("metric", r6("left_value", "left_value"), r6("right_value", "right_value"))


# --- audits -----------------------------------------------------------------------------------


@query(
    "q2_split_audit",
    sql(
        "SELECT split, count(*) AS n, CAST(sum(CASE WHEN gt_detection_win THEN 1 ELSE 0 END) AS BIGINT) AS positives, count(*) // 60 AS whole_windows FROM sp WHERE split IS NOT NULL GROUP BY 1",
        SPLIT_SQL,
    ),
)
def q2(spark, sf):
    """Positives per split and whether its windows have the right size (with U2 for shared clocks)."""
    s = splits.position_split(stream(spark, sf))
    base = s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), big(F.sum(F.col("gt_detection_win").cast("int")), "positives"))
    first = splits.split_bounds(s).select("split", "first_idx")
    sizes = s.join(F.broadcast(first), "split").groupBy("split", F.floor((F.col("idx") - F.col("first_idx")) / SIZE).alias("w")).agg(F.count(F.lit(1)).alias("c"))
    whole = sizes.groupBy("split").agg(big(F.sum((F.col("c") == SIZE).cast("int")), "whole_windows"))
    return base.join(whole, "split")


QCOLS = ["sclk", "pressure", "autoencoder_window_hits"]


@query(
    "q3_row_quality",
    sql(
        f"SELECT count(*) AS total_rows, {i8('sum(CASE WHEN sclk IS NULL THEN 1 ELSE 0 END)', 'sclk_nulls')}, {i8('sum(CASE WHEN pressure IS NULL THEN 1 ELSE 0 END)', 'pressure_nulls')}, "
        f"{i8('sum(CASE WHEN hits IS NULL THEN 1 ELSE 0 END)', 'autoencoder_window_hits_nulls')}, min(pressure) AS min_pressure, max(pressure) AS max_pressure, "
        f"{i8('sum(CASE WHEN abs(pressure - m) > 3 * s THEN 1 ELSE 0 END)', 'outliers')}, {i8('sum(CASE WHEN sclk < prev THEN 1 ELSE 0 END)', 'sclk_falls')}, "
        "count(*) - count(DISTINCT sclk) AS repeated_clocks FROM (SELECT *, lag(sclk) OVER (ORDER BY idx) AS prev FROM ev), (SELECT avg(pressure) AS m, stddev_samp(pressure) AS s FROM ev)"
    ),
)
def q3(spark, sf):
    return audit.row_quality(stream(spark, sf), QCOLS, chunk(spark, sf))


@query(
    "q4_data_warnings",
    sql(
        f"SELECT kind, subject, {q6('value', 'value')} FROM (SELECT 'missing' AS kind, 'autoencoder_window_hits' AS subject, CAST(sum(CASE WHEN hits IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM st "
        "UNION ALL SELECT 'repeated_clocks', 'sclk', CAST(count(*) - count(DISTINCT sclk) AS DOUBLE) FROM st UNION ALL "
        "SELECT 'imbalance', 'gt_detection_win', avg(CASE WHEN gt_detection_win THEN 1.0 ELSE 0.0 END) FROM st) "
        "WHERE (kind = 'missing' AND value > 0) OR (kind = 'repeated_clocks' AND value > 0) OR (kind = 'imbalance' AND (value < 0.1 OR value > 0.9))"
    ),
)
def q4(spark, sf):
    out = audit.data_warnings(stream(spark, sf), QCOLS, chunk=chunk(spark, sf))
    return out.select("kind", "subject", r6("value", "value"))


Q5_PAIRS = list(combinations([*A, "holed", "twin"], 2))


@query(
    "q5_matrix_warnings",
    sql(
        f"SELECT 'correlated' AS kind, s.f1 || '~' || s.f2 AS subject, {q6('s.r', 'value')} FROM (SELECT unnest([" + ", ".join(f"{{'f1': '{a}', 'f2': '{b}', 'r': corr(\"{a}\", \"{b}\")}}" for a, b in Q5_PAIRS) + "]) AS s FROM pl) WHERE abs(s.r) > 0.95 "
        "UNION ALL SELECT 'nan', 'holed', CAST(count(*) FILTER (WHERE holed IS NULL) AS DOUBLE) FROM pl "
        "UNION ALL SELECT 'infinite', 'endless', CAST(count(*) FILTER (WHERE window_id % 13 = 0) AS DOUBLE) FROM pl "
        "UNION ALL SELECT 'constant', 'always_one', 0.0 FROM pl HAVING min(one) = max(one)",
        *FEAT,
        'pl AS (SELECT *, CASE WHEN window_id % 7 <> 0 AND window_id % 11 <> 0 THEN "mean" END AS holed, 2 * "range" + 1 AS twin, 1.0 AS one FROM fl)',
    ),
)
def q5(spark, sf):
    """The window features and four planted columns: nulls and NaN, infinities, a constant, a copy of another."""
    w, i = labelled_windows(spark, sf), F.col("window_id")
    holed = F.when(i % 7 == 0, F.lit(None)).when(i % 11 == 0, F.lit(float("nan"))).otherwise(F.col("mean"))
    planted = w.withColumns({"holed": holed, "endless": F.when(i % 13 == 0, F.lit(float("inf"))).otherwise(F.col("std")), "always_one": F.lit(1.0), "twin": 2 * F.col("range") + 1})
    out = audit.matrix_warnings(planted, [*A, "holed", "twin", "endless", "always_one"])
    return out.select("kind", "subject", r6("value", "value"))


@query(
    "q6_window_integrity",
    sql(
        "SELECT count(*) + count(*) FILTER (WHERE window_id % 50 = 0) AS n_rows, count(*) FILTER (WHERE window_id % 50 = 0) AS duplicate_rows, count(*) FILTER (WHERE window_id % 50 = 0) AS duplicate_ids, min(a.sclk) AS first_start, max(a.sclk) AS last_start, min(w.sclk) AS first_end, max(w.sclk) AS last_end, 0::BIGINT AS chronology_violations "
        "FROM wend w JOIN ev a ON a.idx = w.start_idx"
    ),
)
def q6_(spark, sf):
    """The stored windows with every fiftieth one repeated."""
    w = window_table(spark, sf)
    return audit.window_integrity(w.unionByName(w.filter("window_id % 50 = 0")), chunk(spark, sf))


@query(
    "q6_range_comparison",
    sql(
        "SELECT max(CASE WHEN split = 'val' THEN b.sclk END) AS earlier_end_sclk, min(CASE WHEN split = 'test' THEN a.sclk END) AS later_start_sclk, max(CASE WHEN split = 'val' THEN end_idx END) AS earlier_end_idx, "
        "min(CASE WHEN split = 'test' THEN start_idx END) AS later_start_idx, max(CASE WHEN split = 'val' THEN b.sclk END) < min(CASE WHEN split = 'test' THEN a.sclk END) AS in_order, "
        "max(CASE WHEN split = 'val' THEN end_idx END) >= min(CASE WHEN split = 'test' THEN start_idx END) AS index_overlap FROM fw JOIN ev a ON a.idx = start_idx JOIN ev b ON b.idx = end_idx",
        *FEAT,
    ),
)
def q6b(spark, sf):
    return audit.range_comparison(window_table(spark, sf))


def _miss_sql(col: str) -> str:
    return (
        f"SELECT '{col}' AS feature, 100.0 * sum(CASE WHEN {col} IS NULL AND gt_detection_win THEN 1 ELSE 0 END) / sum(CASE WHEN gt_detection_win THEN 1 ELSE 0 END) AS pp, "
        f"100.0 * sum(CASE WHEN {col} IS NULL AND NOT gt_detection_win THEN 1 ELSE 0 END) / sum(CASE WHEN gt_detection_win THEN 0 ELSE 1 END) AS np FROM mi"
    )


@query(
    "q7_missing_by_class",
    sql(
        f"SELECT feature, {q6('pp', 'pos_missing_pct')}, {q6('np', 'neg_missing_pct')}, CASE WHEN pp = 100 AND np = 0 THEN 'PERFECT_SEPARATION' WHEN pp > 90 AND np < 10 THEN 'STRONG_SEPARATION' ELSE 'NO_LEAKAGE' END AS verdict, "
        f"abs(pp - np) > 50 AS systematic FROM ({_miss_sql('hits')} UNION ALL {_miss_sql('quiet_hits')})",
        "mi AS (SELECT *, CASE WHEN NOT gt_detection_win THEN pressure END AS quiet_hits FROM st)",
    ),
)
def q7(spark, sf):
    """Missing readings by class; ``quiet_hits`` is a column that gives the class away."""
    s = stream(spark, sf).select(
        F.col("autoencoder_window_hits").alias("hits"),
        F.when(~F.col("gt_detection_win"), F.col("pressure")).alias("quiet_hits"),
        F.col("gt_detection_win").cast("int").alias("y"),
    )
    out = audit.missing_by_class(s, ["hits", "quiet_hits"])
    return out.select("feature", r6("pos_missing_pct", "pos_missing_pct"), r6("neg_missing_pct", "neg_missing_pct"), "verdict", "systematic")


Q8 = [*A, "event_copy", "always_one", "span"]


@query(
    "q8_leakage_scan",
    sql(
        "SELECT 'suspicious_name' AS kind, f AS subject, 1.0::DOUBLE AS value FROM (SELECT unnest(" + str(Q8) + ") AS f) WHERE " + " OR ".join(f"contains(f, '{k}')" for k in audit.SUSPICIOUS)
        + "".join(f" UNION ALL SELECT 'label_correlation', '{f}', {q6(f'abs(corr({chr(34)}{f}{chr(34)}, y))', 'value')} FROM pl HAVING abs(corr(\"{f}\", y)) > 0.99" for f in Q8 if f != "always_one")
        + "".join(f" UNION ALL SELECT 'constant', '{f}', 0.0 FROM pl HAVING min(\"{f}\") = max(\"{f}\")" for f in Q8)
        + "".join(f" UNION ALL SELECT 'equal_columns', '{a}~{b}', 0.0 FROM pl HAVING max(abs(\"{a}\" - \"{b}\") - 1e-10 * abs(\"{b}\")) <= 1e-8" for a, b in combinations(Q8, 2)),
        *FEAT,
        'pl AS (SELECT *, CAST(y AS DOUBLE) AS event_copy, 1.0::DOUBLE AS always_one, "range" AS span FROM fl)',
    ),
)
def q8(spark, sf):
    """The scan over all window features plus three planted leaks."""
    w = labelled_windows(spark, sf).withColumn("event_copy", F.col("y").cast("double"))
    w = w.withColumn("always_one", F.lit(1.0)).withColumn("span", F.col("range"))
    out = audit.leakage_scan(w, [*A, "event_copy", "always_one", "span"])
    return out.select("kind", "subject", r6("value", "value"))


@query(
    "q9_training_quality",
    sql(
        f"SELECT n_rows, n_rows < 500 AS is_small, n_rows - d AS duplicate_rows, 0::BIGINT AS flat_features, f AS widest_feature, {q6('v', 'widest_separation')} FROM (SELECT count(*) AS n_rows FROM fl), "
        f"(SELECT count(*) AS d FROM (SELECT DISTINCT {', '.join(chr(34) + f + chr(34) for f in A)} FROM fl)), "
        "(SELECT f, v FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS f, abs(avg(CASE WHEN y = 1 THEN \"{f}\" END) - avg(CASE WHEN y = 0 THEN \"{f}\" END)) AS v FROM fl" for f in A) + ") ORDER BY v DESC LIMIT 1)",
        *FEAT,
    ),
)
def q9(spark, sf):
    out = audit.training_quality(labelled_windows(spark, sf), A)
    return out.select("n_rows", "is_small", "duplicate_rows", big("flat_features", "flat_features"), "widest_feature", r6("widest_separation", "widest_separation"))


@query(
    "q10_duplicate_features",
    sql(
        f"SELECT CASE WHEN max(abs(pressure_drop - range) - 1e-5 * abs(range)) <= 1e-8 THEN 'IDENTICAL' WHEN corr(pressure_drop, range) > 0.95 THEN 'HIGHLY_CORRELATED' ELSE 'DISTINCT' END AS verdict, {q6('corr(pressure_drop, range)', 'r')}, "
        "CAST(sum(CASE WHEN pressure_drop = range THEN 1 ELSE 0 END) AS BIGINT) AS equal_rows FROM fl",
        *FEAT,
    ),
)
def q10(spark, sf):
    out = audit.duplicate_pair(labelled_windows(spark, sf))
    return out.select("verdict", r6("r", "r"), "equal_rows")


def _spread(src: str, tag: str) -> str:
    return f"(SELECT max(m) - min(m) AS {tag}_mean_spread, max(s) - min(s) AS {tag}_std_spread FROM (SELECT split, avg(pressure) AS m, stddev_samp(pressure) AS s FROM {src} GROUP BY 1))"


@query(
    "q11_stats_consistency",
    sql(
        f"SELECT {', '.join(q6(c, c) for c in ('window_mean_spread', 'window_std_spread', 'split_mean_spread', 'split_std_spread', 'zscore_spread'))}, "
        + ", ".join(f"{f}_differs" for f in audit.KEY_FEATURES)
        + ", window_mean_spread > 1 OR window_std_spread > 1 OR zscore_spread > 0.5 OR split_mean_spread < window_mean_spread AS needs_fix FROM "
        + _spread("wrows", "window")
        + ", "
        + _spread("sp WHERE split IS NOT NULL", "split")
        + ", (SELECT max(m_min_zscore) - min(m_min_zscore) AS zscore_spread, "
        + ", ".join(
            f"(max(m_{f}) - min(m_{f})) > 0.1 * abs(avg(m_{f})) OR (max(s_{f}) - min(s_{f})) > 0.1 * abs(avg(s_{f})) AS {f}_differs" for f in audit.KEY_FEATURES
        )
        + " FROM (SELECT split, "
        + ", ".join(f"avg(\"{f}\") AS m_{f}, stddev_samp(\"{f}\") AS s_{f}" for f in audit.KEY_FEATURES)
        + " FROM fl WHERE split IS NOT NULL GROUP BY 1))",
        *FEAT,
        "wrows AS (SELECT fw.split, wl.pressure FROM fw JOIN wl USING (window_id) WHERE fw.y = 1 AND fw.split IS NOT NULL)",
    ),
)
def q11(spark, sf):
    """Statistics of the positive windows' rows, of the splits, and of the features, across splits."""
    s = stream(spark, sf)
    f = labelled_windows(spark, sf).filter(F.col("split").isNotNull())
    starts = f.filter("y = 1").select("window_id", "split", "start_idx")
    rows = windows.windows_from(s.select("idx", "pressure"), starts, SIZE)
    out = audit.stats_consistency(splits.position_split(s), rows, f)
    cols = ["window_mean_spread", "window_std_spread", "split_mean_spread", "split_std_spread", "zscore_spread"]
    return out.select(*[r6(c, c) for c in cols], *[f"{k}_differs" for k in audit.KEY_FEATURES], "needs_fix")


AUC_SQL = (
    "(SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*) FROM (SELECT p FROM wy WHERE y = 1 AND split = '{0}') a, (SELECT p FROM wy WHERE y = 0 AND split = '{0}') b)"
)


@query(
    "q12_score_behaviour",
    sql(
        f"SELECT d AS distinct_positive_scores, {q6('t', 'train_auc')}, {q6('v', 'val_auc')}, d <= 3 AS few_scores, t - v > 0.2 AS overfit FROM "
        f"(SELECT (SELECT count(DISTINCT p) FROM wy WHERE y = 1 AND split = 'train') AS d, {AUC_SQL.format('train')} AS t, {AUC_SQL.format('val')} AS v)",
        SPLIT_Y,
    ),
)
def q12(spark, sf):
    s = split_scores(spark, sf)
    train, val = s.filter("split = 'train'"), s.filter("split = 'val'")
    out = audit.score_behaviour(train, metrics.roc_auc(metrics.score_curve(train)), metrics.roc_auc(metrics.score_curve(val)))
    return out.select("distinct_positive_scores", r6("train_auc", "train_auc"), r6("val_auc", "val_auc"), "few_scores", "overfit")


@query(
    "q13_hits_vs_label",
    sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS feature, {q6(f'corr({c}, y)', 'r')}, {q6(f'avg({c}) FILTER (WHERE y = 1)', 'mean_1')}, {q6(f'stddev_samp({c}) FILTER (WHERE y = 1)', 'std_1')}, "
            f"{q6(f'avg({c}) FILTER (WHERE y = 0)', 'mean_0')}, {q6(f'stddev_samp({c}) FILTER (WHERE y = 0)', 'std_0')}, {q6(f'abs(avg({c}) FILTER (WHERE y = 1) - avg({c}) FILTER (WHERE y = 0))', 'separation')}, abs(corr({c}, y)) > 0.9 AS too_close FROM hy"
            for n, c in (("autoencoder_window_hits", "hits"), ("autoencoder_positive_hit", "pos_hit"))
        ),
        "hy AS (SELECT hits, pos_hit, CASE WHEN gt_detection_win THEN 1 ELSE 0 END AS y FROM st)",
    ),
)
def q13(spark, sf):
    s = stream(spark, sf).withColumn("y", F.col("gt_detection_win").cast("int"))
    out = audit.label_relation(s, ["autoencoder_window_hits", "autoencoder_positive_hit"])
    return out.select("feature", *[r6(c, c) for c in ("r", "mean_1", "std_1", "mean_0", "std_0", "separation")], "too_close")
