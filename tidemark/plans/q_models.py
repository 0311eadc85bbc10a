"""Model queries.

A fitted model's own numbers depend on the library, so its queries return what must hold whatever
they are (class totals, one score per window, shares that add up to one) and compare that with SQL;
rules around the models are compared in full.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates as ag
from tidemark.operators import features as ft
from tidemark.operators import metrics as m
from tidemark.operators import boosting, ml, splits, windows
from tidemark.operators.attach import attach
from tidemark.plans.base import SIZE, STEP, big, chunk, i8, q6, query, r6, scored, sql, stream, stored, wends
from tidemark.plans.q_aggregates import A, FEAT, PAIRS, labelled_windows, window_table
from tidemark.plans.q_metrics import RATES
from tidemark.session import materialise


def part(spark, sf, name):
    return labelled_windows(spark, sf).filter(F.col("split") == name)


def fitted(spark, sf):
    """The default forest on the training period, fitted once per session."""
    return stored(spark, sf, "forest", lambda: ml.fit_forest(part(spark, sf, "train"), A))


def class_totals(rates, *keep):
    """Counts per class and whether all rates lie in 0..1, from confusion counts with rates."""
    inside = [F.coalesce(F.col(r).between(0.0, 1.0), F.lit(True)) for r in RATES]
    return rates.select(*keep, (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"), reduce(and_, inside).alias("rates_valid"))


def totals_sql(where: str) -> str:
    return sql(f"SELECT {i8('sum(y)', 'positives')}, {i8('sum(1 - y)', 'negatives')}, true AS rates_valid FROM fl WHERE {where}", *FEAT)


def forest_scores(spark, sf, name):
    return ml.score(fitted(spark, sf), part(spark, sf, name).select("window_id", "end_idx", "y", *A))


def learned(scores, distinct: int = 10, least: float = 0.7):
    """Whether scores of the rows a model was fitted on are many and rank them (area under the curve); a constant model's are neither."""
    curve = m.score_curve(scores)
    both = attach(curve.agg(F.count(F.lit(1)).alias("scores")), m.roc_auc(curve))
    return both.select(((F.col("scores") >= distinct) & (F.col("roc_auc") >= least)).alias("learned"))


@query("m1_random_forest", sql(f"SELECT {i8('sum(y)', 'positives')}, {i8('sum(1 - y)', 'negatives')}, true AS rates_valid, true AS learned FROM fl WHERE split = 'val'", *FEAT))
def m1(spark, sf):
    rates = class_totals(m.with_rates(m.confusion(forest_scores(spark, sf, "val"), F.col("p") >= 0.5)))
    return attach(rates, learned(forest_scores(spark, sf, "train")))


def split_rows(spark, sf):
    cols = ["window_id", "y", *A]
    return part(spark, sf, "train").select(cols), part(spark, sf, "val").select(cols)


@query("m2_boosted_trees", sql(f"SELECT {i8('sum(y)', 'positives')}, {i8('sum(1 - y)', 'negatives')}, true AS rates_valid, true AS learned, true AS best_kept FROM fl WHERE split = 'val'", *FEAT))
def m2(spark, sf):
    """Up to 1,000 rounds, stopped after 50 without gain in average precision; the kept prefix rates best of all that were looked at."""
    train, val = split_rows(spark, sf)
    fit = boosting.fit_staged(train, val, A)
    rates = class_totals(m.with_rates(m.confusion(fit.trees.score(val), F.col("p") >= 0.5)))
    again = m.average_precision(m.score_curve(fit.trees.score(val))).select((F.abs(F.col("average_precision") - fit.curve[fit.best - 1]) < 1e-9).alias("best_kept"))
    # One shallow first tree may be the best prefix, so few distinct scores are enough.
    return attach(rates, learned(fit.trees.score(train), 5, 0.6), again)


@query(
    "m3_grid_search",
    sql(
        "SELECT CAST(depth AS DOUBLE) AS depth, CAST(rate AS DOUBLE) AS rate, CAST(leaf AS DOUBLE) AS leaf, CAST(sample AS DOUBLE) AS sample, CAST(share AS DOUBLE) AS column_share, CAST(gain AS DOUBLE) AS gain, "
        "positives, negatives, true AS f1_valid, true AS learned FROM "
        + ", ".join(f"(SELECT unnest({values}) AS {'share' if name == 'columns' else name})" for name, values in boosting.GRID.items())
        + f", (SELECT {i8('sum(y)', 'positives')}, {i8('sum(1 - y)', 'negatives')} FROM fl WHERE split = 'val')",
        *FEAT,
    ),
)
def m3(spark, sf):
    """The known 144 settings: all for 2 rounds, the best quarter for 8, and of these the best quarter for 32."""
    train, val = split_rows(spark, sf)
    best, results = boosting.search(train, val, A, boosting.settings(), rungs=(2, 8, 32))
    rows = results.select(
        "depth", "rate", "leaf", "sample", F.col("columns").alias("column_share"), "gain", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"),
        (F.col("f1").between(0.0, 1.0) & (F.col("dropped") == (F.col("rounds") < 32))).alias("f1_valid"),
    )
    return attach(rows, learned(best.score(train)))


@query(
    "m4_time_folds",
    sql("SELECT fold, count(*) AS n, min(end_idx) AS first_idx, max(end_idx) AS last_idx FROM (SELECT end_idx, CAST(floor(end_idx * 6 / n) AS INTEGER) AS fold FROM sc, (SELECT count(*) AS n FROM ev)) GROUP BY 1"),
)
def m4(spark, sf):
    f = ml.time_folds(scored(spark, sf), splits.row_count(stream(spark, sf)))
    return f.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("end_idx").alias("first_idx"), F.max("end_idx").alias("last_idx"))


@query(
    "m4_forward_chaining",
    sql(
        f"SELECT fold, {i8('sum(y)', 'positives')}, {i8('sum(1 - y)', 'negatives')}, true AS rates_valid FROM (SELECT y, CAST(floor(end_idx * 6 / n) AS INTEGER) AS fold FROM fw WHERE label <> 'Omit') WHERE fold BETWEEN 1 AND 5 GROUP BY 1",
        *FEAT,
    ),
)
def m4c(spark, sf):
    rows = labelled_windows(spark, sf).select("window_id", "end_idx", "y", *A)
    folded = materialise(ml.time_folds(rows, splits.row_count(stream(spark, sf))))
    return class_totals(ml.forward_chain(folded, A), "fold")


@query("m5_score_table", sql("SELECT window_id, true AS in_range FROM fl WHERE split = 'test'", *FEAT))
def m5(spark, sf):
    return forest_scores(spark, sf, "test").select("window_id", F.col("p").between(0.0, 1.0).alias("in_range"))


@query("m6_importance", sql("SELECT CAST(15 AS BIGINT) AS features, 1.0::DOUBLE AS total, 1.0::DOUBLE AS last_share, CAST(15 AS BIGINT) AS last_place, true AS none_negative, count(*) AS fitted_rows FROM fl WHERE split = 'train'", *FEAT))
def m6(spark, sf):
    t = ml.importance_table(fitted(spark, sf), A, spark).agg(
        F.count(F.lit(1)).alias("features"), r6(F.sum("importance"), "total"), r6(F.max("cumulative_share"), "last_share"),
        F.max("place").alias("last_place"), (F.min("importance") >= 0).alias("none_negative"),
    )
    return attach(t, part(spark, sf, "train").agg(F.count(F.lit(1)).alias("fitted_rows")))


@query(
    "m6_family_importance",
    sql(
        "SELECT family, features, total, fitted_rows FROM (VALUES ('Temporal Features', 4::BIGINT, 1.0::DOUBLE), ('Pressure Dynamics', 3, 1.0), ('Statistical Measures', 6, 1.0), ('Anomaly Detection', 2, 1.0)) t(family, features, total), "
        "(SELECT count(*) AS fitted_rows FROM fl WHERE split = 'train')",
        *FEAT,
    ),
)
def m6b(spark, sf):
    out = ml.family_importance(ml.importance_table(fitted(spark, sf), A, spark))
    out = out.select("family", "features", r6(F.sum("importance").over(Window.partitionBy(F.lit(0))), "total"))
    return attach(out, part(spark, sf, "train").agg(F.count(F.lit(1)).alias("fitted_rows")))


@query("m7_permutation_importance", sql(f"SELECT feature, n, true AS drop_valid, true AS some_drop FROM (SELECT unnest({A}) AS feature), (SELECT count(*) AS n FROM fl WHERE split = 'train')", *FEAT))
def m7(spark, sf):
    """On the rows the forest was fitted on, shuffling its main feature must cost accuracy; a constant model would lose none."""
    rows = part(spark, sf, "train")
    out = ml.permutation_importance(fitted(spark, sf), rows, A, chunk=chunk(spark, sf))
    most = F.max("mean_drop").over(Window.partitionBy(F.lit(0)))  # one row per feature
    out = out.select("feature", (F.col("mean_drop").between(-1.0, 1.0) & (F.col("std_drop") >= 0)).alias("drop_valid"), (most > 0).alias("some_drop"))
    return attach(out, rows.agg(F.count(F.lit(1)).alias("n")))


def calibrated_checks(out):
    """Rows, mean of the calibrated scores, and how often, by hundredths of the raw score, they turn against their direction."""
    per = out.groupBy(F.floor(F.col("p") * 100).alias("b")).agg(
        F.min("calibrated").alias("lo"), F.max("calibrated").alias("hi"), F.sum("calibrated").alias("s"), F.count(F.lit(1)).alias("n")
    )  # at most 101 rows
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    down = F.coalesce(F.col("lo") < F.max("hi").over(earlier) - 1e-12, F.lit(False)).cast("long")
    up = F.coalesce(F.col("hi") > F.min("lo").over(earlier) + 1e-12, F.lit(False)).cast("long")
    per = per.select("n", "s", down.alias("_down"), up.alias("_up"))
    turns = F.least(F.sum("_down"), F.sum("_up"))
    return per.agg(big(F.sum("n"), "n"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean"), big(turns, "turns"))


CALIBRATED_SQL = "SELECT count(*) AS n, round(avg(y), 4) AS mean, 0::BIGINT AS turns FROM fl WHERE split = 'val'"


@query("m8_isotonic_calibration", sql(CALIBRATED_SQL, *FEAT))
def m8(spark, sf):
    """On the rows it was fitted on, isotonic regression keeps the mean of y and never turns."""
    val = forest_scores(spark, sf, "val").select("window_id", "p", "y")
    return calibrated_checks(ml.calibrate(val, val))


@query("m8_sigmoid_calibration", sql(CALIBRATED_SQL, *FEAT))
def m8b(spark, sf):
    """So does a logistic fit with an intercept, in the direction that it finds."""
    val = forest_scores(spark, sf, "val").select("window_id", "p", "y")
    return calibrated_checks(ml.calibrate(val, val, "sigmoid"))


def gate_windows(spark, sf):
    arrs = windows.window_arrays(stream(spark, sf), SIZE, STEP, chunk=chunk(spark, sf))
    w = arrs.select(((F.col("end_idx") - (SIZE - 1)) / STEP).cast("long").alias("window_id"), "samples")
    return w.join(window_table(spark, sf).select("window_id", "label", "y", "split"), "window_id")


@query("m9_reconstruction_gate", sql("SELECT count(*) AS n, true AS none_negative, true AS exact_in_full, true AS more_is_better FROM wend"))
def m9(spark, sf):
    """Every window has an error; 60 components leave none, and 16 leave more than 32 do."""
    w = materialise(gate_windows(spark, sf))
    quiet = w.filter("split = 'train' and label = 'False'")
    errors = {k: ml.reconstruction_gate(quiet, w, k=k).select("window_id", F.col("gate_score").alias(f"e{k}")) for k in (16, 32, 60)}
    both = errors[16].join(errors[32], "window_id").join(errors[60], "window_id")
    return both.agg(
        F.count(F.lit(1)).alias("n"), (F.min("e16") >= 0).alias("none_negative"), (F.max("e60") < 1e-6).alias("exact_in_full"),
        (F.sum("e16") >= F.sum("e32")).alias("more_is_better"),
    )


@query(
    "m10_keep_top_per_class",
    sql("SELECT window_id, y FROM sc JOIN (SELECT y, quantile_cont(p, 0.5) AS t FROM sc GROUP BY 1) USING (y) WHERE p >= t"),
)
def m10(spark, sf):
    return ml.keep_top(scored(spark, sf).select("window_id", "y", "p"), "p").select("window_id", "y")


@query("m10_keep_above_median", sql("SELECT window_id, y FROM sc WHERE p >= (SELECT quantile_cont(p, 0.5) FROM sc)"))
def m10b(spark, sf):
    return ml.keep_above(scored(spark, sf).select("window_id", "y", "p"), "p").select("window_id", "y")


@query(
    "m11_anomaly_threshold",
    sql("SELECT y, count(*) AS n, CAST(sum(CASE WHEN p > (SELECT quantile_cont(p, 0.95) FROM sc WHERE y = 0) THEN 1 ELSE 0 END) AS BIGINT) AS flagged FROM sc GROUP BY 1"),
)
def m11(spark, sf):
    s = scored(spark, sf).select("y", "p")
    out = ml.flag_anomalies(s, ml.anomaly_threshold(s.filter("y = 0"), "p"), "p")
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), big(F.sum(F.col("anomaly").cast("int")), "flagged"))


@query(
    "m12_two_stage",
    sql(f"SELECT window_id, p >= 0.5 AS passed, {q6('CASE WHEN p >= 0.5 THEN pressure / (pressure + 100.0) ELSE 0.0 END', 'score')} FROM wend"),
)
def m12(spark, sf):
    w = wends(spark, sf).select("window_id", "p", "pressure")
    out = ml.two_stage(w, F.col("p") >= 0.5, F.col("pressure") / (F.col("pressure") + 100.0))
    return out.select("window_id", "passed", r6("score", "score"))


@query(
    "m12_filtered_ratio",
    sql(f"SELECT count(*) AS n, {i8('sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END)', 'passed')}, {q6('1 - sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) / count(*)', 'filtered_ratio')} FROM wend"),
)
def m12b(spark, sf):
    w = wends(spark, sf).select("window_id", "p")
    out = ml.filtered_ratio(ml.two_stage(w, F.col("p") >= 0.5, F.col("p")))
    return out.select("n", "passed", r6("filtered_ratio", "filtered_ratio"))


@query("m12_two_stage_models", sql("SELECT window_id, true AS score_valid FROM fl WHERE split = 'test'", *FEAT))
def m12c(spark, sf):
    """Reconstruction gate at its 95th percentile of quiet windows, then the forest; gated-out windows score 0."""
    w = materialise(gate_windows(spark, sf))
    quiet = w.filter("split = 'train' and label = 'False'")
    gated = ml.reconstruction_gate(quiet, w).select("window_id", "gate_score", "label", "split")
    t = ml.anomaly_threshold(gated.filter("split = 'train' and label = 'False'"), "gate_score")
    flagged = ml.flag_anomalies(gated, t, "gate_score").select("window_id", "anomaly")
    s = forest_scores(spark, sf, "test").select("window_id", "p", "y").join(flagged, "window_id")
    out = ml.two_stage(s, F.col("anomaly"), F.col("p"))
    return out.select("window_id", (F.col("score") == F.when(F.col("passed"), F.col("p")).otherwise(0.0)).alias("score_valid"))


@query(
    "m14_feature_selection",
    sql(
        "SELECT feature FROM imp WHERE importance >= 0.01 AND feature NOT IN (SELECT CASE WHEN a.importance < b.importance THEN f1 ELSE f2 END FROM "
        "(SELECT s.f1 AS f1, s.f2 AS f2, s.r AS r FROM (SELECT unnest([" + ", ".join(f"{{'f1': '{a}', 'f2': '{b}', 'r': corr(\"{a}\", \"{b}\")}}" for a, b in PAIRS) + "]) AS s FROM fl)) c "
        "JOIN imp a ON a.feature = f1 JOIN imp b ON b.feature = f2 WHERE abs(r) > 0.8 AND a.importance >= 0.01 AND b.importance >= 0.01)",
        *FEAT,
        "imp AS (" + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, abs(avg(CASE WHEN y = 1 THEN \"{f}\" END) - avg(CASE WHEN y = 0 THEN \"{f}\" END)) / "
            f"(stddev_samp(CASE WHEN y = 1 THEN \"{f}\" END) + stddev_samp(CASE WHEN y = 0 THEN \"{f}\" END)) AS importance FROM fl"
            for f in A
        ) + ")",
    ),
)
def m14(spark, sf):
    """Class separation stands in for importance, so that the answer is exact; pairs above 0.8."""
    w = labelled_windows(spark, sf)
    imp = ag.feature_separation(w, A).select("feature", F.col("separation").alias("importance"))
    return ml.select_features(imp, ag.correlation_matrix(w, A), 0.01, 0.8).select("feature")


@query(
    "m15_standardise",
    sql(
        "SELECT window_id, " + ", ".join(q6(f"(\"{c}\" - m_{c}) / s_{c}", c) for c in ("mean", "std", "range")) + " FROM fl, (SELECT "
        + ", ".join(f"avg(\"{c}\") AS m_{c}, stddev_pop(\"{c}\") AS s_{c}" for c in ("mean", "std", "range")) + " FROM fl WHERE split = 'train')",
        *FEAT,
    ),
)
def m15(spark, sf):
    cols = ["mean", "std", "range"]
    out = ml.standardise(part(spark, sf, "train"), labelled_windows(spark, sf).select("window_id", *cols), cols)
    return out.select("window_id", *[r6(c, c) for c in cols])
