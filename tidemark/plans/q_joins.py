"""Join queries, run detection, events and as-of alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, intervals, panes, runs
from tidemark.operators.event_metrics import in_event
from tidemark.operators.index import in_chunk, rolling
from tidemark.operators.windows import right_edge_label, tumbling
from tidemark.plans.base import (
    FLAGS, SIZE, STEP, big, catalogue, chunk, i8, q6, query, r6, raw_stream, scored, sql, stream, wends,
)
from tidemark.plans.q_features import LONG_SQL

HIT = 0.8  # score threshold of the event queries


def runs_cte(name: str, cond: str, src: str = "st") -> str:
    return (
        f"{name} AS (SELECT min(idx) AS s, max(idx) AS e, min(sclk) AS s_sclk, max(sclk) AS e_sclk FROM "
        f"(SELECT idx, sclk, idx - row_number() OVER (ORDER BY idx) AS g FROM {src} WHERE {cond}) GROUP BY g)"
    )


TRUE_RUNS = runs_cte("tr", "gt_fwhm OR gt_detection_win")
PRED_RUNS = runs_cte("pr", "p >= 0.8")


@query(
    "j1_lookup_by_clock",
    sql(
        "SELECT c.vortex, c.want AS sclk, coalesce(min(ev.idx), -1) AS idx FROM "
        "(SELECT vortex, CASE WHEN vortex % 7 = 0 THEN -sclk ELSE sclk END AS want FROM cat) c "
        "LEFT JOIN ev ON ev.sclk = c.want GROUP BY 1, 2"
    ),
)
def j1(spark, sf):
    """Lookup by clock; every seventh event is given a clock that is not there."""
    c = catalogue(spark, sf)
    wanted = c.select("vortex", F.when(F.col("vortex") % 7 == 0, -F.col("sclk")).otherwise(F.col("sclk")).alias("sclk"))
    out = intervals.lookup_by_clock(wanted, raw_stream(spark, sf))
    return out.select("vortex", "sclk", F.coalesce("idx", F.lit(-1).cast("long")).alias("idx"))


@query(
    "j2_window_rows_labels",
    sql(f"SELECT label, count(*) AS n, {q6('sum(pressure)', 'total')} FROM wl GROUP BY 1", LONG_SQL),
)
def j2(spark, sf):
    """Rows of all windows under their window's label: sums of windows stand for their rows."""
    label = right_edge_label(F.col("gt_detection_win"), F.col("gt_fwhm"))
    labels = wends(spark, sf).select("window_id", label.alias("label"))
    wanted = {"rows": panes.count(), "sum": panes.total(F.col("pressure"))}
    sums = panes.window_summary(stream(spark, sf).select("idx", "pressure"), SIZE, STEP, wanted, chunk(spark, sf))
    return sums.join(labels, "window_id", "left").groupBy("label").agg(big(F.sum("rows"), "n"), r6(F.sum("sum"), "total"))


@query(
    "j3_map_scores",
    sql(
        "SELECT idx, b.p AS score FROM ev LEFT JOIN "
        "(SELECT window_id // 4 AS k, arg_max(p, end_idx) AS p FROM sc GROUP BY 1) b ON idx // 60 = b.k"
    ),
)
def j3(spark, sf):
    rows = tumbling(stream(spark, sf).select("idx"), SIZE)
    scores = scored(spark, sf).withColumn("window_id", F.floor(F.col("window_id") / 4).cast("long"))
    return asof.map_scores(rows, scores).select("idx", F.col("p").alias("score"))


@query(
    "j5_interval_flags",
    sql("SELECT idx, gt_fwhm, gt_detection_win, gt_4xfwhm FROM st WHERE gt_fwhm OR gt_detection_win OR gt_4xfwhm"),
)
def j5(spark, sf):
    out = intervals.flag_around(raw_stream(spark, sf).select("idx"), catalogue(spark, sf), FLAGS)
    return out.filter("gt_fwhm or gt_detection_win or gt_4xfwhm")


@query("j6_points_in_events", sql("SELECT idx, s AS event_start FROM st JOIN tr ON idx BETWEEN s AND e WHERE p >= 0.8", TRUE_RUNS))
def j6(spark, sf):
    s = stream(spark, sf)
    hits = s.filter(F.col("p") >= HIT).select("idx")
    events = runs.runs(s, in_event(), chunk(spark, sf))
    return intervals.interval_join(hits, events, "idx", "start_idx", "end_idx").select(
        "idx", F.col("start_idx").alias("event_start")
    )


@query(
    "j7_interval_overlap",
    sql(
        "SELECT pr.s AS pred_start, tr.s AS true_start FROM pr, tr WHERE pr.e >= tr.s AND greatest(pr.s - 60, 0) <= tr.e",
        TRUE_RUNS,
        PRED_RUNS,
    ),
)
def j7(spark, sf):
    s, c = stream(spark, sf), chunk(spark, sf)
    pred = runs.runs(s, F.col("p") >= HIT, c).select(
        F.col("start_idx").alias("pred_start"),
        F.greatest(F.col("start_idx") - SIZE, F.lit(0)).alias("p_lo"),
        F.col("end_idx").alias("p_hi"),
    )
    true = runs.runs(s, in_event(), c).select(F.col("start_idx").alias("true_start"), F.col("end_idx").alias("t_hi"))
    return intervals.overlap_join(pred, true, "p_lo", "p_hi", "true_start", "t_hi").select("pred_start", "true_start")


@query(
    "j8_containment",
    sql("SELECT window_id, vortex FROM wend JOIN cat ON start_idx >= centre - 100 AND end_idx <= centre + 100"),
)
def j8(spark, sf):
    spans = catalogue(spark, sf).select(
        "vortex", (F.col("centre") - 100).alias("span_start"), (F.col("centre") + 100).alias("span_end")
    )
    windows = wends(spark, sf).select("window_id", "start_idx", "end_idx")
    return runs.windows_in_events(windows, spans).select("window_id", "vortex")


@query(
    "j9_window_ends_in_regions",
    sql(
        f"SELECT s AS region_start, count(*) AS n, {q6('max(p)', 'max_p')}, {q6('avg(p)', 'mean_p')} "
        "FROM tr JOIN wend ON end_idx BETWEEN s AND e GROUP BY 1",
        TRUE_RUNS,
    ),
)
def j9(spark, sf):
    regions = runs.runs(stream(spark, sf), in_event(), chunk(spark, sf)).select(
        F.col("start_idx").alias("region_start"), F.col("end_idx").alias("region_end")
    )
    ends = wends(spark, sf).select("window_id", F.col("end_idx").alias("at"), "p")
    hit = intervals.interval_join(ends, regions, "at", "region_start", "region_end")
    return hit.groupBy("region_start").agg(
        F.count(F.lit(1)).alias("n"), r6(F.max("p"), "max_p"), r6(F.avg("p"), "mean_p")
    )


@query(
    "j10_semi_anti",
    sql(
        "SELECT 'in' AS side, count(*) AS n FROM wend WHERE window_id IN (SELECT window_id FROM sc WHERE y = 1) "
        "UNION ALL SELECT 'out', count(*) FROM wend WHERE window_id NOT IN (SELECT window_id FROM sc WHERE y = 1)"
    ),
)
def j10(spark, sf):
    w = wends(spark, sf).select("window_id")
    keys = scored(spark, sf).filter("y = 1").select("window_id")
    inside = w.join(keys, "window_id", "left_semi").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("in"))
    outside = w.join(keys, "window_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("out"))
    return inside.unionByName(outside).select("side", "n")


@query(
    "j11_asof_precursor",
    sql(
        "SELECT vortex, coalesce(max(st.idx), -1) AS last_mark, count(st.idx) AS earlier FROM cat "
        "LEFT JOIN st ON st.idx < centre AND gt_detection_win GROUP BY 1"
    ),
)
def j11(spark, sf):
    at = catalogue(spark, sf).select("vortex", F.col("centre").alias("idx"))
    out = asof.marks_before(stream(spark, sf), at, "gt_detection_win", chunk(spark, sf))
    return out.select("vortex", F.coalesce("last_mark", F.lit(-1).cast("long")).alias("last_mark"), big("earlier", "earlier"))


@query(
    "j12_c1_score_alignment",
    sql(
        "SELECT idx, coalesce(last_value(sp.p IGNORE NULLS) OVER (ORDER BY idx), 0.0) AS score "
        "FROM ev LEFT JOIN (SELECT end_idx, p FROM sc) sp ON idx = end_idx"
    ),
)
def j12(spark, sf):
    """J12 + C1 + C2: newest window score at or before each sample, 0 before the first."""
    out = asof.align_scores(stream(spark, sf).select("idx"), scored(spark, sf), chunk=chunk(spark, sf))
    return out.select("idx", "score")


@query(
    "j12_sparse_variant",
    sql("SELECT idx, coalesce(sp.p, 0.0) AS score FROM ev LEFT JOIN (SELECT end_idx, p FROM sc) sp ON idx = end_idx"),
)
def j12b(spark, sf):
    """J12, the other form: the score stays on its end sample, 0 elsewhere."""
    return asof.align_scores(stream(spark, sf).select("idx"), scored(spark, sf), forward=False).select("idx", "score")


@query(
    "j15_m13_offset_ensemble",
    sql(
        f"SELECT a.idx AS i, {q6('0.3 * a.p + coalesce(0.7 * (b.pressure / (b.pressure + 100.0)), 0.0)', 'score')} "
        "FROM ev a LEFT JOIN ev b ON b.idx = a.idx + 30"
    ),
)
def j15(spark, sf):
    s = stream(spark, sf)
    a = s.select(F.col("idx").alias("i"), F.col("p").alias("score"))
    b = s.select(F.col("idx").alias("i"), (F.col("pressure") / (F.col("pressure") + 100.0)).alias("score"))
    return asof.offset_join(a, b).select("i", r6("score", "score"))


# --- runs and events ------------------------------------------------------------------------


@query("g1_contiguous_regions", sql("SELECT s AS start_idx, e AS end_idx FROM pr", runs_cte("pr", "p >= 0.3")))
def g1(spark, sf):
    return runs.runs(stream(spark, sf), F.col("p") >= 0.3, chunk(spark, sf))


@query(
    "g1b_runs_in_clock_units",
    sql(
        "SELECT s AS start_idx, s_sclk AS start_sclk, coalesce(nx.sclk - 1, e_sclk) AS end_sclk FROM tr LEFT JOIN ev nx ON nx.idx = e + 1",
        TRUE_RUNS,
    ),
)
def g1b(spark, sf):
    out = runs.clock_runs(stream(spark, sf), in_event(), chunk(spark, sf))
    return out.select("start_idx", "start_sclk", "end_sclk")


NESTED_SQL = [
    runs_cte("wide", "gt_4xfwhm"),
    runs_cte("dr", "gt_detection_win"),
    """core AS (SELECT s AS w0, e AS w1, min(st.idx) AS f0, max(st.idx) AS f1, min(pressure) AS mn FROM wide
        JOIN st ON st.idx BETWEEN s AND e AND gt_fwhm GROUP BY 1, 2)""",
    """pk AS (SELECT w0, min(st.idx) AS peak_idx FROM core JOIN st ON st.idx BETWEEN f0 AND f1 AND gt_fwhm AND pressure = mn GROUP BY 1)""",
    """ld AS (SELECT w0, max(st.idx) AS d1 FROM core JOIN st ON gt_detection_win AND st.idx < f0 AND st.idx > greatest(w0, f0 - 200) GROUP BY 1)""",
    """ds AS (SELECT ld.w0, d1, greatest(dr.s, greatest(ld.w0, d1 - 200) + 1) AS d0 FROM ld JOIN dr ON d1 BETWEEN dr.s AND dr.e)""",
]


@query(
    "g2_nested_events",
    sql(
        "SELECT peak_idx, st.sclk AS peak_sclk, coalesce(d0, -1) AS detection_start, coalesce(d1, -1) AS detection_end, f0 AS fwhm_start, "
        f"f1 AS fwhm_end, core.w0 AS fourxfwhm_start, w1 AS fourxfwhm_end, {q6('peak_idx / 3600.0', 'time_hours')} "
        "FROM core JOIN pk USING (w0) JOIN st ON st.idx = peak_idx LEFT JOIN ds ON ds.w0 = core.w0",
        *NESTED_SQL,
    ),
)
def g2(spark, sf):
    e = runs.nested_events(stream(spark, sf), chunk(spark, sf))
    minus = F.lit(-1).cast("long")
    return e.select(
        "peak_idx", "peak_sclk", F.coalesce("detection_start", minus).alias("detection_start"),
        F.coalesce("detection_end", minus).alias("detection_end"), "fwhm_start", "fwhm_end", "fourxfwhm_start",
        "fourxfwhm_end", r6("time_hours", "time_hours"),
    )


@query(
    "g3_state_events",
    sql(
        f"SELECT s AS start_idx, e AS end_idx, {i8('sum(CASE WHEN gt_fwhm THEN 1 ELSE 0 END)', 'fwhm_rows')}, "
        f"{i8('sum(CASE WHEN gt_detection_win AND NOT gt_fwhm THEN 1 ELSE 0 END)', 'detection_rows')} "
        "FROM tr JOIN st ON idx BETWEEN s AND e GROUP BY 1, 2",
        TRUE_RUNS,
    ),
)
def g3(spark, sf):
    return runs.state_events(stream(spark, sf), chunk(spark, sf)).select("start_idx", "end_idx", "fwhm_rows", "detection_rows")


@query(
    "g4_complete_events",
    sql(
        "SELECT s AS start_idx, e AS end_idx FROM tr JOIN st ON idx BETWEEN s AND e GROUP BY 1, 2 "
        "HAVING bool_or(gt_fwhm) AND bool_or(gt_detection_win AND NOT gt_fwhm)",
        TRUE_RUNS,
    ),
)
def g4(spark, sf):
    return runs.complete_events(stream(spark, sf), chunk(spark, sf)).select("start_idx", "end_idx")


@query(
    "g5_vote",
    sql(
        "SELECT window_id, CASE WHEN sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (ORDER BY window_id ROWS 2 PRECEDING) >= 2 "
        "THEN 1 ELSE 0 END AS vote FROM wend"
    ),
)
def g5(spark, sf):
    """Trailing 2-of-3 vote over every window in order."""
    from tidemark.operators.metrics import trailing_vote

    return trailing_vote(wends(spark, sf).select("window_id", "p"), 0.5, 3, 2, by="window_id").select("window_id", "vote")


@query("g6_row_number", sql("SELECT idx, row_number() OVER (PARTITION BY idx // 60 ORDER BY sclk, idx) - 1 AS pos FROM ev"))
def g6(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("window_id").orderBy("sclk", "idx")
    rows = tumbling(stream(spark, sf).select("idx", "sclk"), SIZE)
    return rows.select("idx", (F.row_number().over(w) - 1).cast("long").alias("pos"))


@query(
    "g7_monotonic_violations",
    sql(
        f"SELECT {i8('sum(CASE WHEN dp < 0 THEN 1 ELSE 0 END)', 'pressure_falls')}, {i8('sum(CASE WHEN dc < 0 THEN 1 ELSE 0 END)', 'clock_falls')} "
        "FROM (SELECT pressure - lag(pressure) OVER (ORDER BY idx) AS dp, sclk - lag(sclk) OVER (ORDER BY idx) AS dc FROM ev)"
    ),
)
def g7(spark, sf):
    w = in_chunk()
    d = rolling(
        stream(spark, sf).select("idx", "sclk", "pressure"),
        {"dp": F.col("pressure") - F.lag("pressure").over(w), "dc": F.col("sclk") - F.lag("sclk").over(w)},
        1,
        chunk=chunk(spark, sf),
    )
    return d.agg(
        big(F.sum((F.col("dp") < 0).cast("long")), "pressure_falls"), big(F.sum((F.col("dc") < 0).cast("long")), "clock_falls")
    )
