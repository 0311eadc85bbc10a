"""Scoring, curves, threshold selection, event metrics, rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions.scalars import prior_corrected
from tidemark.operators import event_metrics as em
from tidemark.operators import metrics as m
from tidemark.operators import runs, sampling, splits
from tidemark.operators import thresholds as th
from tidemark.operators.index import exact_percentiles
from tidemark.operators.windows import right_edge_label
from tidemark.plans.base import big, catalogue, chunk, i8, q6, query, r6, scored, sql, stream, wends
from tidemark.plans.q_features import SUB_SQL
from tidemark.plans.q_joins import HIT, PRED_RUNS, TRUE_RUNS
from tidemark.session import materialise

COUNTS = ("tp", "fp", "tn", "fn")
RATES = ("precision", "recall", "f1", "accuracy", "tpr", "fpr", "fnr")


def grid_cte(values, name: str = "grid") -> str:
    """Thresholds as exact doubles (text casts, so that no decimal rounding creeps in)."""
    return f"{name} AS (SELECT unnest([{', '.join(repr(repr(float(v))) for v in values)}]::DOUBLE[]) AS t)"


def counts_sql(cond: str) -> str:
    parts = {"tp": f"{cond} AND y = 1", "fp": f"{cond} AND y = 0", "tn": f"NOT {cond} AND y = 0", "fn": f"NOT {cond} AND y = 1"}
    return ", ".join(f"CAST(coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0) AS BIGINT) AS {n}" for n, c in parts.items())


RATE_SQL = {
    "precision": "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END",
    "recall": "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END",
    "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp) / (2 * tp + fp + fn) ELSE 0.0 END",
    "accuracy": "(tp + tn) / (tp + fp + tn + fn)",
    "tpr": "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END",
    "fpr": "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END",
    "fnr": "CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0.0 END",
}


def rates_cte(src: str, name: str, keep: str = "t,") -> str:
    return f"{name} AS (SELECT {keep} tp, fp, tn, fn, {', '.join(f'{e} AS {n}' for n, e in RATE_SQL.items())} FROM {src})"


def sweep_cte(values, name: str = "sw", src: str = "sc") -> list[str]:
    return [grid_cte(values), f"{name}_c AS (SELECT t, {counts_sql('p >= t')} FROM {src}, grid GROUP BY t)", rates_cte(f"{name}_c", name)]


COUNT_COLS = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS)
RATE_COLS = ", ".join(q6(r, r) for r in RATES)


def rated(df, *keep):
    return df.select(*keep, *[big(c, c) for c in COUNTS], *[r6(r, r) for r in RATES])


@query(
    "t1_t2_confusion_rates",
    sql(f"SELECT {COUNT_COLS}, {RATE_COLS} FROM r", f"c AS (SELECT {counts_sql('p >= 0.5')} FROM sc)", rates_cte("c", "r", "")),
)
def t1(spark, sf):
    return rated(m.with_rates(m.confusion(scored(spark, sf), F.col("p") >= 0.5)))


@query(
    "t3_classification_report",
    sql(
        f"SELECT class, {q6('precision', 'precision')}, {q6('recall', 'recall')}, {q6('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM u",
        f"c AS (SELECT {counts_sql('p >= 0.5')} FROM sc)",
        rates_cte("c", "p1", ""),
        "c0 AS (SELECT tn AS tp, fn AS fp, tp AS tn, fp AS fn FROM c)",
        rates_cte("c0", "p0", ""),
        "b AS (SELECT '1' AS class, precision, recall, f1, tp + fn AS support FROM p1 UNION ALL SELECT '0', precision, recall, f1, tp + fn FROM p0)",
        "u AS (SELECT * FROM b UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM b UNION ALL "
        "SELECT 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM b)",
    ),
)
def t3(spark, sf):
    r = m.classification_report(scored(spark, sf), F.col("p") >= 0.5)
    return r.select("class", r6("precision", "precision"), r6("recall", "recall"), r6("f1", "f1"), big("support", "support"))


CURVE = """
ds AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM sc GROUP BY p),
cv AS (SELECT p AS threshold, pos, neg, CAST(sum(pos) OVER (ORDER BY p DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY p DESC) AS BIGINT) AS fp,
       CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(neg) OVER () AS BIGINT) AS n_neg FROM ds),
pr AS (SELECT *, tp / (tp + fp) AS precision, tp / n_pos AS recall, tp / n_pos AS tpr, fp / n_neg AS fpr FROM cv)"""


def curve(spark, sf):
    return m.score_curve(scored(spark, sf))


@query("t4_roc_curve", sql(f"SELECT {q6('threshold', 'threshold')}, tp, fp, {q6('tpr', 'tpr')}, {q6('fpr', 'fpr')} FROM pr", CURVE))
def t4(spark, sf):
    r = m.roc_points(curve(spark, sf))
    return r.select(r6("threshold", "threshold"), "tp", "fp", r6("tpr", "tpr"), r6("fpr", "fpr"))


@query(
    "t4_roc_auc",
    sql(
        f"SELECT {q6('sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) / count(*)', 'roc_auc')} "
        "FROM (SELECT p FROM sc WHERE y = 1) a, (SELECT p FROM sc WHERE y = 0) b"
    ),
)
def t4b(spark, sf):
    return m.roc_auc(curve(spark, sf)).select(r6("roc_auc", "roc_auc"))


@query(
    "t5_pr_curve",
    sql(
        f"SELECT {q6('threshold', 'threshold')}, tp, fp, {q6('precision', 'precision')}, {q6('recall', 'recall')} FROM pr "
        "UNION ALL SELECT NULL, 0, 0, 1.0, 0.0",
        CURVE,
    ),
)
def t5(spark, sf):
    r = m.with_end_point(m.pr_points(curve(spark, sf)))
    return r.select(r6("threshold", "threshold"), "tp", "fp", r6("precision", "precision"), r6("recall", "recall"))


@query(
    "t5_average_precision",
    sql(
        f"SELECT {q6('sum((recall - prev) * precision)', 'average_precision')} FROM (SELECT *, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0.0) AS prev FROM pr)",
        CURVE,
    ),
)
def t5b(spark, sf):
    return m.average_precision(curve(spark, sf)).select(r6("average_precision", "average_precision"))


GRIDS = {
    "t6_sweep_05_95": [i * 0.05 for i in range(1, 20)],
    "t6_sweep_01_31": [i * 0.01 for i in range(1, 32)],
    "t6_sweep_10_95": [0.1 + i * 0.05 for i in range(18)],
    "t6_sweep_81": m.linspace(0.1, 0.9, 81),
    "t6_sweep_41": m.linspace(0.3, 0.7, 41),
    "t6_sweep_99": m.linspace(0.01, 0.99, 99),
    "t6_sweep_list": [0.1, 0.3, 0.45, 0.5, 0.6, 0.75, 0.9],
}


def _sweep_query(name, values):
    @query(name, sql(f"SELECT {q6('t', 'threshold')}, {COUNT_COLS}, {RATE_COLS} FROM sw", *sweep_cte(values)))
    def run(spark, sf):
        return rated(m.with_rates(m.sweep(scored(spark, sf), values)), r6("threshold", "threshold"))

    return run


for _name, _values in GRIDS.items():
    _sweep_query(_name, _values)


@query(
    "t6b_sweep_over_range",
    sql(
        f"SELECT {q6('t', 'threshold')}, {COUNT_COLS} FROM c",
        "rg AS (SELECT min(p) AS lo, max(p) AS hi FROM sc)",
        "g AS (SELECT CASE WHEN i = 100 THEN hi ELSE lo + i * ((hi - lo) / 100) END AS t FROM rg, (SELECT unnest(range(101)) AS i))",
        f"c AS (SELECT t, {counts_sql('p >= t')} FROM sc, g GROUP BY t)",
    ),
)
def t6b(spark, sf):
    s = scored(spark, sf)
    span = s.agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    i = F.explode(F.sequence(F.lit(0), F.lit(100)))
    grid = span.select("lo", "hi", i.alias("i")).select(
        F.when(F.col("i") == 100, F.col("hi")).otherwise(F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / 100)).alias("threshold")
    )
    return m.sweep_table(s, grid.distinct()).select(r6("threshold", "threshold"), *[big(c, c) for c in COUNTS])


#: 50 to 95 by 5, and 97 and 99.
PCTS = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.97, 0.99]


@query(
    "t6c_percentile_thresholds",
    sql(
        f"SELECT q, {q6('t', 'threshold')}, {COUNT_COLS} FROM c",
        f"g AS (SELECT unnest({PCTS}::DOUBLE[]) AS q, unnest(quantile_cont(p, {PCTS})) AS t FROM sc)",
        f"c AS (SELECT q, t, {counts_sql('p > t')} FROM sc, g GROUP BY q, t)",
    ),
)
def t6c(spark, sf):
    """Scores strictly above their own percentiles."""
    s = scored(spark, sf)
    ts = exact_percentiles(s, "p", PCTS).select("q", F.col("p").alias("threshold"))
    return m.sweep_table(s, ts, strict=True).select("q", r6("threshold", "threshold"), *[big(c, c) for c in COUNTS])


@query(
    "t7_youden",
    sql(f"SELECT {q6('threshold', 'threshold')}, {q6('tpr - fpr', 'j')} FROM pr ORDER BY tpr - fpr DESC, pr.threshold DESC LIMIT 1", CURVE),
)
def t7(spark, sf):
    return th.youden(m.roc_points(curve(spark, sf))).select(r6("threshold", "threshold"), r6("j", "j"))


@query(
    "t8_f1_optimal",
    sql(
        f"SELECT {q6('threshold', 'threshold')}, {q6('precision', 'precision')}, {q6('recall', 'recall')}, {q6('f1', 'f1')} FROM "
        "(SELECT *, 2 * (precision * recall) / (precision + recall + CAST('1e-08' AS DOUBLE)) AS f1 FROM pr) x ORDER BY x.f1 DESC, x.threshold LIMIT 1",
        CURVE,
    ),
)
def t8(spark, sf):
    b = th.f1_optimal(m.pr_points(curve(spark, sf)))
    return b.select(*[r6(c, c) for c in ("threshold", "precision", "recall", "f1")])


@query(
    "t9_cost_optimal",
    sql(f"SELECT {q6('t', 'threshold')}, {q6('cost', 'cost')} FROM (SELECT t, fp * 1.0 + fn * 10.0 AS cost FROM sw) ORDER BY cost, t LIMIT 1", *sweep_cte(th.COST_GRID)),
)
def t9(spark, sf):
    b = th.cost_optimal(m.sweep(scored(spark, sf), th.COST_GRID))
    return b.select(r6("threshold", "threshold"), r6("cost", "cost"))


@query(
    "t9_cost_optimal_continuous",
    sql(
        f"SELECT {q6('threshold', 'threshold')}, {q6('cost', 'cost')} FROM (SELECT threshold, fp * 1.0 + (n_pos - tp) * 10.0 AS cost FROM pr) x ORDER BY x.cost, x.threshold LIMIT 1",
        CURVE,
    ),
)
def t9c(spark, sf):
    """The cost changes at distinct scores only, so its least value over all thresholds is on the curve."""
    c = curve(spark, sf).withColumn("fn", F.col("n_pos") - F.col("tp"))
    return th.cost_optimal(c).select(r6("threshold", "threshold"), r6("cost", "cost"))


@query(
    "t10_mission_cost",
    sql(
        f"SELECT {q6('t', 'threshold')}, {q6('cost', 'cost')} FROM (SELECT t, fn * 10.0 + fp / (tp + fp + tn + fn) * 600 * 24 AS cost FROM sw) ORDER BY cost, t LIMIT 1",
        *sweep_cte(th.MISSION_GRID),
    ),
)
def t10(spark, sf):
    b = th.mission_cost(m.sweep(scored(spark, sf), th.MISSION_GRID))
    return b.select(r6("threshold", "threshold"), r6("cost", "cost"))


def _mode_sql(cond: str, key: str) -> str:
    return (
        f"SELECT threshold, precision, recall FROM pr, tops WHERE {cond} ORDER BY {key} DESC, threshold LIMIT 1"
    )


@query(
    "t11_operating_modes",
    sql(
        f"SELECT mode, {q6('threshold', 'threshold')}, {q6('precision', 'precision')}, {q6('recall', 'recall')} FROM ("
        "SELECT 'high_precision' AS mode, * FROM hp UNION ALL SELECT 'high_recall', * FROM hr UNION ALL SELECT 'compat', * FROM cf)",
        CURVE,
        "tops AS (SELECT max(precision) AS mp, max(recall) AS mr FROM pr)",
        f"hp AS ({_mode_sql('precision >= CASE WHEN mp >= 0.9 THEN 0.9 ELSE mp * 0.95 END', 'recall')})",
        f"hr AS ({_mode_sql('recall >= CASE WHEN mr >= 0.9 THEN 0.9 ELSE mr * 0.95 END', 'precision')})",
        "cf AS (SELECT threshold, precision, recall FROM pr ORDER BY 2 * (precision * recall) / (precision + recall + CAST('1e-08' AS DOUBLE)) DESC, threshold LIMIT 1)",
    ),
)
def t11(spark, sf):
    pr = materialise(m.pr_points(curve(spark, sf)))  # three selections read it
    cols = ["threshold", "precision", "recall"]
    hp = th.high_precision(pr).select(F.lit("high_precision").alias("mode"), *cols)
    hr = th.high_recall(pr).select(F.lit("high_recall").alias("mode"), *cols)
    cf = th.high_precision(pr, compat=True).select(F.lit("compat").alias("mode"), *cols)
    return hp.unionByName(hr).unionByName(cf).select("mode", *[r6(c, c) for c in cols])


RULE_GRID = GRIDS["t6_sweep_05_95"]


@query(
    "t12_rule_picks",
    sql(
        f"SELECT rule, {q6('t', 'threshold')}, {q6('precision', 'precision')}, {q6('recall', 'recall')}, {q6('f1', 'f1')}, {q6('fpr', 'fpr')} FROM ("
        "(SELECT 'max_f1' AS rule, * FROM sw ORDER BY f1 DESC, t LIMIT 1) UNION ALL "
        "(SELECT 'high_precision', * FROM sw WHERE precision >= 0.1 ORDER BY recall DESC, t LIMIT 1) UNION ALL "
        "(SELECT 'high_recall', * FROM sw WHERE recall >= 0.5 ORDER BY precision DESC, t LIMIT 1) UNION ALL "
        "(SELECT 'balanced', * FROM sw ORDER BY 1 - abs(precision - recall) DESC, t LIMIT 1))",
        *sweep_cte(RULE_GRID),
    ),
)
def t12(spark, sf):
    picks = th.rule_picks(m.with_rates(m.sweep(scored(spark, sf), RULE_GRID)))
    return picks.select("rule", *[r6(c, c) for c in ("threshold", "precision", "recall", "f1", "fpr")])


@query(
    "t13_precision_target",
    sql(
        f"SELECT target, {q6('t', 'threshold')}, {COUNT_COLS} FROM ("
        "(SELECT 'none' AS target, * FROM sw WHERE tp + fp > 0 ORDER BY precision DESC, t LIMIT 1) UNION ALL "
        "(SELECT '0.05', * FROM sw WHERE tp + fp > 0 ORDER BY CASE WHEN precision >= 0.05 THEN 1 ELSE 0 END DESC, "
        "CASE WHEN precision >= 0.05 THEN recall ELSE precision END DESC, t LIMIT 1))",
        *sweep_cte(th.PRECISION_GRID),
    ),
)
def t13(spark, sf):
    rates = m.with_rates(m.sweep(scored(spark, sf), th.PRECISION_GRID))
    free = th.precision_target(rates).withColumn("target", F.lit("none"))
    aimed = th.precision_target(rates, 0.05).withColumn("target", F.lit("0.05"))
    return free.unionByName(aimed).select("target", r6("threshold", "threshold"), *[big(c, c) for c in COUNTS])


NAMED_SQL = [
    CURVE,
    *sweep_cte(th.COST_GRID),
    """named AS (
  SELECT 0 AS rank, 'roc_optimal' AS name, threshold AS t FROM (SELECT threshold FROM pr ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1)
  UNION ALL SELECT 1, 'f1_optimal', threshold FROM (SELECT threshold FROM pr ORDER BY 2 * (precision * recall) / (precision + recall + CAST('1e-08' AS DOUBLE)) DESC, threshold LIMIT 1)
  UNION ALL SELECT 2, 'cost_optimal', t FROM (SELECT t FROM sw ORDER BY fp * 1.0 + fn * 10.0, t LIMIT 1))""",
    f"nc AS (SELECT rank, name, t, {counts_sql('p >= t')} FROM sc, named GROUP BY 1, 2, 3)",
    rates_cte("nc", "nr", "rank, name, t,"),
    """nf AS (SELECT *, fp / (tp + fp + tn + fn) * 600 AS fph FROM nr)""",
    """ns AS (SELECT *, precision * 3 + (CASE WHEN recall > 0.3 THEN (recall - 0.3) * 2 ELSE -1 END)
         + (CASE WHEN fph < 15 THEN (15 - fph) / 15 * 2 ELSE 0 END) + f1 AS score FROM nf)""",
]


def named_thresholds(spark, sf):
    """The three headline thresholds with counts, rates and false alarms per assumed hour."""
    s = scored(spark, sf)
    c = curve(spark, sf)
    pick = [
        th.youden(m.roc_points(c)).select(F.lit(0).alias("rank"), F.lit("roc_optimal").alias("name"), "threshold"),
        th.f1_optimal(m.pr_points(c)).select(F.lit(1).alias("rank"), F.lit("f1_optimal").alias("name"), "threshold"),
        th.cost_optimal(m.sweep(s, th.COST_GRID)).select(F.lit(2).alias("rank"), F.lit("cost_optimal").alias("name"), "threshold"),
    ]
    named = pick[0].unionByName(pick[1]).unionByName(pick[2])
    out = m.with_rates(m.sweep_table(s, named))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return out.withColumn("fp_per_hour", th.fp_per_hour(F.col("fp"), n))


@query(
    "t14_recommendation",
    sql(
        f"SELECT kind, name, {q6('t', 'threshold')}, {q6('v', 'score')} FROM ("
        "(SELECT 'weighted' AS kind, name, t, score AS v FROM ns ORDER BY score DESC, rank LIMIT 1) UNION ALL "
        "(SELECT 'constrained', name, t, CASE WHEN recall >= 0.3 AND fph <= 400 THEN precision ELSE f1 END AS v FROM ns "
        "ORDER BY CASE WHEN recall >= 0.3 AND fph <= 400 THEN 1 ELSE 0 END DESC, v DESC, rank LIMIT 1))",
        *NAMED_SQL,
    ),
)
def t14(spark, sf):
    named = materialise(named_thresholds(spark, sf))
    a = th.recommend(named).withColumn("kind", F.lit("weighted"))
    b = th.recommend(named, 0.3, 400.0).withColumn("kind", F.lit("constrained"))
    return a.unionByName(b).select("kind", "name", r6("threshold", "threshold"), r6("score", "score"))


@query(
    "t15_fp_per_hour",
    sql(
        f"SELECT {q6('fp / n * 600', 'assumed')}, {q6('fp / hours', 'observed')} FROM "
        "(SELECT sum(CASE WHEN p >= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS fp, count(*) AS n FROM sc), "
        "(SELECT (max(b.sclk) - min(a.sclk)) / 3600.0 AS hours FROM wend JOIN st a ON a.idx = start_idx JOIN st b ON b.idx = end_idx)"
    ),
)
def t15(spark, sf):
    """The observed period is taken before Omit windows are dropped."""
    c = m.confusion(scored(spark, sf), F.col("p") >= 0.5)
    s = stream(spark, sf).select("idx", "sclk")
    w = wends(spark, sf)
    first = w.agg(F.min("start_idx").alias("idx"))
    start = attach(s, first.withColumnRenamed("idx", "_first")).filter(F.col("idx") == F.col("_first")).agg(F.min("sclk").alias("t0"))
    last = w.agg(F.max("sclk").alias("t1"))
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return attach(c, start, last).select(
        r6(th.fp_per_hour(F.col("fp"), n), "assumed"), r6(F.col("fp") / ((F.col("t1") - F.col("t0")) / 3600.0), "observed")
    )


@query(
    "t16_mission_rates",
    sql(
        f"SELECT {q6('fn / (tp + fp + tn + fn) * 100', 'missed_rate')}, {q6('(tn + fn) / (tp + fp + tn + fn)', 'energy_saved')}, "
        f"{q6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END', 'data_quality')} FROM c",
        f"c AS (SELECT {counts_sql('p >= 0.5')} FROM sc)",
    ),
)
def t16(spark, sf):
    r = th.mission_rates(m.confusion(scored(spark, sf), F.col("p") >= 0.5))
    return r.select(*[r6(c, c) for c in ("missed_rate", "energy_saved", "data_quality")])


@query(
    "t17_prior_correction",
    sql(
        f"SELECT window_id, {q6('o / (1 + o)', 'p')} FROM (SELECT window_id, "
        "c / (1 - c) * ((CAST(0.01 AS DOUBLE) / (1 - CAST(0.01 AS DOUBLE))) / (CAST(0.5 AS DOUBLE) / (1 - CAST(0.5 AS DOUBLE)))) AS o FROM "
        "(SELECT window_id, least(greatest(p, CAST('1e-10' AS DOUBLE)), 1 - CAST('1e-10' AS DOUBLE)) AS c FROM sc))"
    ),
)
def t17(spark, sf):
    return scored(spark, sf).select("window_id", r6(prior_corrected(F.col("p"), 0.5, 0.01), "p"))


PRF_SQL = (
    f"{q6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END', 'precision')}, "
    f"{q6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END', 'recall')}, "
    f"{q6('CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp) / (2 * tp + fp + fn) ELSE 0.0 END', 'f1')}"
)


def prf_out(df, *counts):
    return df.select(*[big(c, c) for c in counts], *[r6(c, c) for c in ("precision", "recall", "f1")])


@query(
    "t18_event_level",
    sql(
        f"SELECT tp, fp, fn, {PRF_SQL} FROM (SELECT (SELECT count(DISTINCT s) FROM tr JOIN st ON idx BETWEEN s AND e WHERE p >= 0.8) AS tp, "
        "(SELECT count(*) FROM st WHERE p >= 0.8 AND NOT (gt_fwhm OR gt_detection_win)) AS fp, "
        "(SELECT count(*) FROM tr) - (SELECT count(DISTINCT s) FROM tr JOIN st ON idx BETWEEN s AND e WHERE p >= 0.8) AS fn)",
        TRUE_RUNS,
    ),
)
def t18(spark, sf):
    s = stream(spark, sf)
    return prf_out(em.event_counts(s, s.filter(F.col("p") >= HIT).select("idx"), chunk=chunk(spark, sf)), "tp", "fp", "fn")


@query(
    "t19_event_overlap",
    sql(
        f"SELECT tp, fp, fn, {PRF_SQL} FROM (SELECT (SELECT count(DISTINCT ts) FROM ov) AS tp, "
        "(SELECT count(*) FROM pr) - (SELECT count(DISTINCT ps) FROM ov) AS fp, (SELECT count(*) FROM tr) - (SELECT count(DISTINCT ts) FROM ov) AS fn)",
        TRUE_RUNS,
        PRED_RUNS,
        "ov AS (SELECT pr.s AS ps, tr.s AS ts FROM pr, tr WHERE pr.e >= tr.s AND greatest(pr.s - 60, 0) <= tr.e)",
    ),
)
def t19(spark, sf):
    s, c = stream(spark, sf), chunk(spark, sf)
    pred = runs.runs(s, F.col("p") >= HIT, c)
    return prf_out(em.overlap_counts(s, pred, chunk=c), "tp", "fp", "fn")


def _latch_sql(trigger: str, hit: str) -> str:
    return (
        f"SELECT tp, fp, tn, fn, {PRF_SQL} FROM (SELECT "
        "CAST(coalesce(sum(CASE WHEN tg IS NOT NULL THEN e - tg + 1 ELSE 0 END), 0) AS BIGINT) AS tp, "
        "CAST(coalesce(sum(CASE WHEN tg IS NOT NULL THEN tg - s ELSE e - s + 1 END), 0) AS BIGINT) AS fn, "
        f"any_value(fp) AS fp, any_value(tn) AS tn FROM (SELECT s, e, min(CASE WHEN {trigger} THEN idx END) AS tg FROM tr JOIN pst ON idx BETWEEN s AND e GROUP BY 1, 2), "
        f"(SELECT CAST(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN {hit} THEN 0 ELSE 1 END) AS BIGINT) AS tn "
        "FROM pst WHERE NOT (gt_fwhm OR gt_detection_win)))"
    )


@query("g9_latch_on", sql(_latch_sql("p >= 0.5 AND gt_detection_win", "p >= 0.5"), TRUE_RUNS, "pst AS (SELECT * FROM st)"))
def g9(spark, sf):
    return prf_out(em.latch_on(stream(spark, sf), F.col("p") >= 0.5, chunk(spark, sf)), "tp", "fp", "tn", "fn")


@query(
    "t20_triggered_pointwise",
    sql(
        _latch_sql("h", "h"),
        TRUE_RUNS,
        "pst AS (SELECT st.*, coalesce(b.p >= 0.8, false) AS h FROM st LEFT JOIN ev b ON b.idx + 59 = st.idx)",
    ),
)
def t20(spark, sf):
    s = stream(spark, sf)
    preds = s.select(F.col("idx").alias("i"), (F.col("p") >= HIT).cast("int").alias("pred"))
    return prf_out(em.triggered_points(s, preds, chunk=chunk(spark, sf)), "tp", "fp", "tn", "fn")


@query(
    "t21_lead_time",
    sql(
        f"SELECT count(*) AS events, {q6('avg(l)', 'mean_lead')}, {q6('median(l)', 'median_lead')}, {i8('min(l)', 'min_lead')}, {i8('max(l)', 'max_lead')}, {q6('stddev_pop(l)', 'std_lead')} "
        "FROM (SELECT min(CASE WHEN p >= 0.6 AND gt_detection_win THEN idx END) - s AS l FROM tr JOIN st ON idx BETWEEN s AND e GROUP BY s) WHERE l IS NOT NULL",
        TRUE_RUNS,
    ),
)
def t21(spark, sf):
    r = em.lead_times(stream(spark, sf), F.col("p") >= 0.6, chunk(spark, sf))
    return r.select(
        "events", r6("mean_lead", "mean_lead"), r6("median_lead", "median_lead"), big("min_lead", "min_lead"),
        big("max_lead", "max_lead"), r6("std_lead", "std_lead"),
    )


@query(
    "t22_event_groups",
    sql(
        f"SELECT {COUNT_COLS}, {q6('precision', 'precision')}, {q6('recall', 'recall')}, {q6('f1', 'f1')} FROM r",
        SUB_SQL,
        "z AS (SELECT vortex, right_idx BETWEEN r0 AND r1 AS ml, CASE WHEN sd > 0 THEN (p0 - p1) / sd ELSE 0.0 END AS z FROM sw JOIN red USING (vortex))",
        "g AS (SELECT vortex, CASE WHEN bool_or(ml) THEN 1 ELSE 0 END AS y, bool_or(z / (1 + abs(z)) >= 0.7) AS h FROM z GROUP BY 1)",
        f"c AS (SELECT {counts_sql('h')} FROM g)",
        rates_cte("c", "r", ""),
    ),
)
def t22(spark, sf):
    subs = sampling.anchored_subwindows(stream(spark, sf), catalogue(spark, sf))
    z = F.col("z_score")
    r = em.group_validation(subs, "vortex", F.col("ml_label"), z / (1 + F.abs(z)) >= 0.7)
    return prf_out(r, *COUNTS)


@query(
    "t23_confidence_sweep",
    sql(
        f"SELECT {q6('t', 'threshold')}, hits, misses, {q6('CASE WHEN misses > 0 THEN hits / misses ELSE 0.0 END', 'hit_ratio')} FROM ("
        "SELECT t, CAST(sum(CASE WHEN p >= t AND (gt_fwhm OR gt_detection_win) THEN 1 ELSE 0 END) AS BIGINT) AS hits, "
        "CAST(sum(CASE WHEN p >= t AND NOT (gt_fwhm OR gt_detection_win) THEN 1 ELSE 0 END) AS BIGINT) AS misses FROM st, grid WHERE p >= 0.5 GROUP BY t)",
        grid_cte(th.COST_GRID),
    ),
)
def t23(spark, sf):
    s = stream(spark, sf)
    out = em.confidence_sweep(s, s.filter(F.col("p") >= 0.5), th.COST_GRID, chunk(spark, sf))
    return out.select(r6("threshold", "threshold"), big("hits", "hits"), big("misses", "misses"), r6("hit_ratio", "hit_ratio"))


METRICS = ["precision", "recall", "f1", "accuracy"]


@query(
    "t25_compare_to_baseline",
    sql(
        f"SELECT metric, {q6('b', 'baseline')}, {q6('n', 'new')}, {q6('n - b', 'change')}, {q6('CASE WHEN b > 0 THEN (n - b) / b * 100 ELSE 0.0 END', 'change_pct')}, "
        "CASE WHEN n > b THEN 'IMPROVED' WHEN n < b THEN 'WORSE' ELSE 'SAME' END AS status FROM ("
        + " UNION ALL ".join(f"SELECT '{x}' AS metric, (SELECT {x} FROM rb) AS b, (SELECT {x} FROM rn) AS n" for x in METRICS)
        + ")",
        f"cb AS (SELECT {counts_sql('p >= 0.5')} FROM sc)",
        f"cn AS (SELECT {counts_sql('p >= 0.7')} FROM sc)",
        rates_cte("cb", "rb", ""),
        rates_cte("cn", "rn", ""),
    ),
)
def t25(spark, sf):
    s = scored(spark, sf)
    base = m.with_rates(m.confusion(s, F.col("p") >= 0.5))
    new = m.with_rates(m.confusion(s, F.col("p") >= 0.7))
    out = th.compare(base, new, METRICS)
    return out.select("metric", *[r6(c, c) for c in ("baseline", "new", "change", "change_pct")], "status")


# --- several models and splits ---------------------------------------------------------------

MODEL_SQL = """
cnt2 AS (SELECT count(*) AS n FROM ev),
ms AS (SELECT window_id, end_idx, y, model, CASE model WHEN 'a' THEN p WHEN 'b' THEN pressure / (pressure + 100.0) ELSE 1 - p END AS p,
  CASE WHEN end_idx < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
    WHEN end_idx >= floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.035 AS DOUBLE))) AND end_idx < floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.035 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
    WHEN end_idx >= floor(n * (CAST(0.7 AS DOUBLE) + 2 * CAST(0.035 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'test' END AS split
  FROM sc, cnt2, (SELECT unnest(['a', 'b', 'c']) AS model)),
msp AS (SELECT * FROM ms WHERE split IS NOT NULL)"""


def model_scores(spark, sf):
    """Three surrogate models' scores on the split windows, long form."""
    w = wends(spark, sf)
    p, pr = F.col("p"), F.col("pressure")
    each = F.array(*[
        F.struct(F.lit(k).alias("model"), e.alias("p")) for k, e in (("a", p), ("b", pr / (pr + 100.0)), ("c", 1 - p))
    ])
    label = right_edge_label(F.col("gt_detection_win"), F.col("gt_fwhm"))
    rows = w.withColumn("label", label).filter(F.col("label") != "Omit")
    rows = rows.select("window_id", "end_idx", (F.col("label") == "True").cast("int").alias("y"), F.inline(each))
    return splits.position_split(rows, by="end_idx", rows=splits.row_count(stream(spark, sf)))


@query(
    "j14_models_thresholds_splits",
    sql(
        f"SELECT model, split, {q6('t', 'threshold')}, {COUNT_COLS}, {RATE_COLS} FROM r",
        MODEL_SQL,
        grid_cte(GRIDS["t6_sweep_list"]),
        f"c AS (SELECT model, split, t, {counts_sql('p >= t')} FROM msp, grid GROUP BY 1, 2, 3)",
        rates_cte("c", "r", "model, split, t,"),
    ),
)
def j14(spark, sf):
    s = m.sweep(model_scores(spark, sf), GRIDS["t6_sweep_list"], by=["model", "split"])
    return rated(m.with_rates(s), "model", "split", r6("threshold", "threshold"))


TUNE = [
    MODEL_SQL,
    grid_cte(th.COST_GRID),
    f"vc AS (SELECT model, t, {counts_sql('p >= t')} FROM msp, grid WHERE split = 'val' GROUP BY 1, 2)",
    rates_cte("vc", "vr", "model, t,"),
    "tuned AS (SELECT model, t, f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, t) AS rn FROM vr) WHERE rn = 1)",
]


@query(
    "t26_frozen_threshold_test",
    sql(
        f"SELECT model, {q6('t', 'threshold')}, {COUNT_COLS}, {RATE_COLS} FROM r",
        *TUNE,
        f"tc AS (SELECT model, t, {counts_sql('p >= t')} FROM msp JOIN tuned USING (model) WHERE split = 'test' GROUP BY 1, 2)",
        rates_cte("tc", "r", "model, t,"),
    ),
)
def t26(spark, sf):
    s = model_scores(spark, sf)
    tuned = th.tune_by_f1(s.filter("split = 'val'"), th.COST_GRID)
    return rated(th.frozen_test(s.filter("split = 'test'"), tuned), "model", r6("threshold", "threshold"))


@query(
    "t25_winners",
    sql(
        f"SELECT metric, model AS winner, {q6('v', 'value')} FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v DESC, model) AS rn FROM ("
        + " UNION ALL ".join(f"SELECT '{x}' AS metric, model, {x} AS v FROM r" for x in ("precision", "recall", "f1"))
        + ")) WHERE rn = 1",
        MODEL_SQL,
        f"tc AS (SELECT model, {counts_sql('p >= 0.5')} FROM msp WHERE split = 'test' GROUP BY 1)",
        rates_cte("tc", "r", "model,"),
    ),
)
def t25b(spark, sf):
    rates = m.with_rates(m.confusion(model_scores(spark, sf).filter("split = 'test'"), F.col("p") >= 0.5, by=["model"]))
    out = th.winners(rates.withColumn("rank", F.ascii("model")), ["precision", "recall", "f1"])
    return out.select("metric", "winner", r6("value", "value"))


@query(
    "j16_nearest_threshold",
    sql(
        f"SELECT {q6('b.t', 'threshold')}, {q6('b.f1', 'f1')}, {q6('o.t', 'other_threshold')}, {q6('o.f1', 'other_f1')} FROM tuned b JOIN tr2 o ON abs(o.t - b.t) < 0.01 WHERE b.model = 'a' ORDER BY o.t LIMIT 1",
        *TUNE,
        f"tc AS (SELECT t, {counts_sql('p >= t')} FROM msp, grid WHERE split = 'test' AND model = 'a' GROUP BY 1)",
        rates_cte("tc", "tr2", "t,"),
    ),
)
def j16(spark, sf):
    s = model_scores(spark, sf).filter("model = 'a'")
    val = th.tune_by_f1(s.filter("split = 'val'"), th.COST_GRID).select("threshold", "f1")
    test = m.with_rates(m.sweep(s.filter("split = 'test'"), th.COST_GRID)).select("threshold", "f1")
    out = th.nearest_threshold(val, test)
    return out.select(*[r6(c, c) for c in ("threshold", "f1", "other_threshold", "other_f1")])


# --- top-k -----------------------------------------------------------------------------------


@query(
    "k1_top_per_outcome",
    sql(
        f"SELECT outcome, window_id, {q6('p', 'p')} FROM (SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY p DESC, window_id) AS rn FROM ("
        "SELECT window_id, p, CASE WHEN y = 1 AND p >= 0.5 THEN 'TP' WHEN y = 1 THEN 'Miss' WHEN p >= 0.5 THEN 'FP' END AS outcome FROM sc) WHERE outcome IS NOT NULL) WHERE rn <= 5"
    ),
)
def k1(spark, sf):
    hit, y = F.col("p") >= 0.5, F.col("y") == 1
    outcome = F.when(hit & y, "TP").when(y, "Miss").when(hit, "FP")
    s = scored(spark, sf).select("window_id", "p", outcome.alias("outcome")).filter(F.col("outcome").isNotNull())
    w = Window.partitionBy("outcome").orderBy(F.desc("p"), "window_id")
    return s.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("outcome", "window_id", r6("p", "p"))


@query(
    "k2_extremes",
    sql(
        f"SELECT kind, window_id, {q6('p', 'p')} FROM ((SELECT 'normal_high' AS kind, window_id, p FROM sc WHERE y = 0 ORDER BY p DESC, window_id LIMIT 10) "
        "UNION ALL (SELECT 'event_low', window_id, p FROM sc WHERE y = 1 ORDER BY p, window_id LIMIT 10))"
    ),
)
def k2(spark, sf):
    s = scored(spark, sf).select("window_id", "p", "y")
    hi = s.filter("y = 0").orderBy(F.desc("p"), "window_id").limit(10).withColumn("kind", F.lit("normal_high"))
    lo = s.filter("y = 1").orderBy("p", "window_id").limit(10).withColumn("kind", F.lit("event_low"))
    return hi.unionByName(lo).select("kind", "window_id", r6("p", "p"))


@query(
    "k4_best_row",
    sql(f"SELECT {q6('t', 'threshold')}, {q6('f1', 'f1')} FROM (SELECT t, f1 FROM sw ORDER BY f1 DESC, t LIMIT 1)", *sweep_cte(RULE_GRID)),
)
def k4(spark, sf):
    rates = m.with_rates(m.sweep(scored(spark, sf), RULE_GRID))
    return m.best(rates, F.col("f1"), F.col("threshold")).select(r6("threshold", "threshold"), r6("f1", "f1"))


@query(
    "k5_example_selection",
    sql(
        "SELECT window_id, y FROM (SELECT window_id, y, rn, count(*) FILTER (WHERE rn <= 30 AND y = 1) OVER () AS np, count(*) FILTER (WHERE rn <= 30 AND y = 0) OVER () AS nn "
        "FROM (SELECT window_id, y, row_number() OVER (PARTITION BY y ORDER BY window_id) AS rn FROM sc)) "
        "WHERE rn <= 30 OR (rn <= 60 - CASE WHEN y = 1 THEN nn ELSE np END)"
    ),
)
def k5(spark, sf):
    """Half positives, half negatives; where a class runs short the other one fills up to 60."""
    s = scored(spark, sf).select("window_id", "y")
    n = 60
    pos = s.filter("y = 1").orderBy("window_id").limit(n)
    neg = s.filter("y = 0").orderBy("window_id").limit(n)
    both = pos.unionByName(neg)  # at most 2·60 rows from here on
    w = Window.partitionBy("y").orderBy("window_id")
    both = both.withColumn("rn", F.row_number().over(w))
    have = both.agg(
        F.sum(((F.col("rn") <= n // 2) & (F.col("y") == 1)).cast("int")).alias("np"),
        F.sum(((F.col("rn") <= n // 2) & (F.col("y") == 0)).cast("int")).alias("nn"),
    )
    other = F.when(F.col("y") == 1, F.col("nn")).otherwise(F.col("np"))
    return (
        attach(both, have)
        .filter((F.col("rn") <= n // 2) | (F.col("rn") <= n - other))
        .select("window_id", "y")
    )


@query(
    "k6_sorted_results",
    sql(f"SELECT row_number() OVER (ORDER BY f1 DESC, t) AS place, {q6('t', 'threshold')}, {q6('f1', 'f1')} FROM sw", *sweep_cte(RULE_GRID)),
)
def k6(spark, sf):
    rates = m.with_rates(m.sweep(scored(spark, sf), RULE_GRID))
    w = Window.orderBy(F.desc("f1"), "threshold")  # grid-sized
    return rates.select(F.row_number().over(w).cast("long").alias("place"), r6("threshold", "threshold"), r6("f1", "f1")).orderBy("place")
