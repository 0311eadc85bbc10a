"""Windowing, labelling and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import panes, sampling, splits, windows
from tidemark.operators.attach import attach
from tidemark.operators.event_metrics import in_event
from tidemark.operators.index import renumber, rolling, trailing
from tidemark.operators.intervals import flag_inside, merged_by_bin
from tidemark.plans.base import (
    SIZE, STEP, big, catalogue, chunk, i8, q6, query, r6, scored, sql, stream, wends,
)
from tidemark.plans.q_features import BASE_SQL, SPLIT_SQL, STATS_SQL, feature_sql, rounded, train_stats
from tidemark.plans.q_joins import runs_cte
from tidemark.session import materialise



def _label():
    return windows.right_edge_label(F.col("gt_detection_win"), F.col("gt_fwhm"))


@query(
    "w1_window_contents",
    sql(
        f"SELECT window_id, count(*) AS n, min(s.idx) AS first_idx, max(s.idx) AS last_idx, {q6('sum(s.pressure)', 'total')} "
        "FROM wend, (SELECT unnest(range(60)) AS o) JOIN st s ON s.idx = start_idx + o GROUP BY 1"
    ),
)
def w1(spark, sf):
    i, v = F.col("idx"), F.col("pressure")
    wanted = {"n": panes.count(), "first_idx": panes.low(i), "last_idx": panes.high(i), "total": panes.total(v)}
    out = panes.window_summary(stream(spark, sf).select("idx", "pressure"), SIZE, STEP, wanted, chunk(spark, sf))
    return out.select("window_id", "n", "first_idx", "last_idx", r6("total", "total"))


@query("w1b_renumbered_survivors", sql("SELECT row_number() OVER (ORDER BY end_idx) - 1 AS sliding_window_id, end_idx, label FROM sc"))
def w1b(spark, sf):
    ends = wends(spark, sf).select("window_id", "end_idx", _label().alias("label"))
    return windows.numbered_survivors(ends, chunk(spark, sf)).select("sliding_window_id", "end_idx", "label")


@query("w2_right_edge_labels", sql("SELECT window_id, start_idx, end_idx, label FROM wend"))
def w2(spark, sf):
    return wends(spark, sf).select("window_id", "start_idx", "end_idx", _label().alias("label"))


@query(
    "w3_any_in_window",
    sql(
        "SELECT idx, CASE WHEN bool_or(gt_detection_win) OVER w THEN 1 ELSE 0 END AS any_detection, "
        "CASE WHEN bool_or(gt_detection_win OR gt_fwhm) OVER w THEN 1 ELSE 0 END AS any_event FROM st "
        "WINDOW w AS (ORDER BY idx ROWS 59 PRECEDING) QUALIFY row_number() OVER (ORDER BY idx) >= 60"
    ),
)
def w3(spark, sf):
    out = rolling(
        stream(spark, sf).select("idx", "gt_detection_win", "gt_fwhm"),
        {
            "any_detection": F.max(F.col("gt_detection_win").cast("int")).over(trailing(SIZE)),
            "any_event": F.max(in_event().cast("int")).over(trailing(SIZE)),
        },
        SIZE - 1,
        chunk=chunk(spark, sf),
    )
    return out.filter(F.col("idx") >= SIZE - 1).select("idx", "any_detection", "any_event")


@query(
    "w4_next_sample_label",
    sql("SELECT a.idx, CASE WHEN b.gt_detection_win THEN 1 ELSE 0 END AS window_label FROM st a JOIN st b ON b.idx = a.idx + 1 WHERE a.idx >= 59"),
)
def w4(spark, sf):
    out = windows.next_sample_label(stream(spark, sf).select("idx", "gt_detection_win"), F.col("gt_detection_win"), SIZE, chunk(spark, sf))
    return out.select("idx", "window_label")


def _ahead(lo: int, hi: int) -> str:
    return sql(
        "SELECT idx AS start_idx, CASE WHEN coalesce(bool_or(gt_detection_win) OVER (ORDER BY idx ROWS BETWEEN "
        f"{lo} FOLLOWING AND {hi} FOLLOWING), false) THEN 1 ELSE 0 END AS window_label FROM st "
        "QUALIFY idx + 59 <= max(idx) OVER ()"
    )


@query("w5_any_in_next_10_from_start", _ahead(0, 9))
def w5(spark, sf):
    out = windows.lookahead_label(stream(spark, sf).select("idx", "gt_detection_win"), F.col("gt_detection_win"), SIZE, 10, "start", chunk(spark, sf))
    return out.select("start_idx", "window_label")


@query("w5_any_in_next_10_after_end", _ahead(60, 69))
def w5b(spark, sf):
    out = windows.lookahead_label(stream(spark, sf).select("idx", "gt_detection_win"), F.col("gt_detection_win"), SIZE, 10, "end", chunk(spark, sf))
    return out.select("start_idx", "window_label")


@query("w6_right_edge_step_1", sql("SELECT idx AS end_idx, CASE WHEN gt_detection_win THEN 1 ELSE 0 END AS window_label FROM st WHERE idx >= 59"))
def w6(spark, sf):
    return windows.window_ends(stream(spark, sf), SIZE, 1).select("end_idx", F.col("gt_detection_win").cast("int").alias("window_label"))


DET_RUNS = runs_cte("dr", "gt_detection_win")
POS_SQL = """
posw AS (SELECT vortex, cat.sclk, centre, max(dr.s) - 60 AS start_idx FROM cat JOIN dr ON dr.s <= centre GROUP BY 1, 2, 3 HAVING max(dr.s) >= 60)"""
FIRST_SQL = """
posw AS (SELECT vortex, cat.sclk, centre, min(dr.s) - 60 AS start_idx FROM cat JOIN dr ON dr.s <= centre GROUP BY 1, 2, 3 HAVING min(dr.s) >= 60)"""


def positives(spark, sf, mode="own_run"):
    return sampling.positive_starts(stream(spark, sf), catalogue(spark, sf), SIZE, mode, chunk(spark, sf))


@query(
    "w7_positive_windows",
    sql(
        f"SELECT vortex, start_idx, count(*) AS n, {q6('sum(pressure)', 'total')} FROM posw JOIN st ON idx BETWEEN start_idx AND start_idx + 59 GROUP BY 1, 2",
        DET_RUNS,
        POS_SQL,
    ),
)
def w7(spark, sf):
    rows = windows.windows_from(
        stream(spark, sf).select("idx", "pressure"), positives(spark, sf).select("vortex", "start_idx"), SIZE
    )
    return rows.groupBy("vortex", "start_idx").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("pressure"), "total"))


#: Precursor runs within each split, and the splits' first rows.
SPLIT_RUNS = [
    SPLIT_SQL,
    "dsp AS (SELECT split, min(idx) AS s FROM (SELECT st.idx, split, st.idx - row_number() OVER (ORDER BY st.idx) AS g FROM st JOIN sp ON sp.idx = st.idx WHERE st.gt_detection_win AND split IS NOT NULL) GROUP BY split, g)",
    "org AS (SELECT split, min(idx) AS origin, max(idx) AS last FROM sp WHERE split IS NOT NULL GROUP BY 1)",
]


@query(
    "w7_window_outcomes",
    sql(
        "SELECT split, outcome, count(*) AS n FROM (SELECT org.split, CASE WHEN centre NOT BETWEEN origin AND last THEN 'clock_not_found' WHEN run IS NULL THEN 'no_precursor' "
        "WHEN run - 60 < origin THEN 'too_short' ELSE 'extracted' END AS outcome FROM (SELECT org.*, cat.centre, (SELECT max(s) FROM dsp WHERE dsp.split = org.split AND s <= cat.centre) AS run FROM org, cat) org) GROUP BY 1, 2",
        *SPLIT_RUNS,
    ),
)
def w7c(spark, sf):
    """What became of every catalogue event in each split, and why windows were lost."""
    whole = splits.position_split(stream(spark, sf))
    out = None
    for name in ("train", "val", "test"):
        own = whole.filter(F.col("split") == name)
        span = own.agg(F.min("idx").alias("_lo"), F.max("idx").alias("_hi"))
        events = attach(catalogue(spark, sf), span).withColumn("centre", F.when(F.col("centre").between(F.col("_lo"), F.col("_hi")), F.col("centre"))).drop("_lo", "_hi")
        counted = sampling.positive_outcomes(own, events, SIZE, chunk=chunk(spark, sf)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
        counted = counted.select(F.lit(name).alias("split"), "outcome", "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("w7_positive_windows_first_in_split", sql("SELECT vortex, start_idx FROM posw", DET_RUNS, FIRST_SQL))
def w7b(spark, sf):
    return positives(spark, sf, "first_in_split").select("vortex", "start_idx")


@query(
    "w11_context_windows",
    sql(
        "SELECT centre, idx - centre AS rel_pos, pressure FROM cat JOIN st ON idx >= centre - 60 AND idx < centre + 60 "
        "WHERE centre >= 60 AND centre + 59 <= (SELECT max(idx) FROM st)"
    ),
)
def w11(spark, sf):
    anchors = catalogue(spark, sf).select(F.col("centre").alias("anchor"))
    out = windows.context_windows(stream(spark, sf).select("idx", "pressure"), anchors, 60, 60)
    return out.select(F.col("anchor").alias("centre"), "rel_pos", "pressure")


HASH = "((({0}) % 2147483648) * 1103515245 + 12345) % 2147483648"
FLAGGED_SQL = """
anyl AS (SELECT idx, CASE WHEN bool_or(gt_detection_win) OVER (ORDER BY idx ROWS 59 PRECEDING) THEN 1 ELSE 0 END AS a, gt_detection_win FROM st
         QUALIFY row_number() OVER (ORDER BY idx) >= 60)"""


@query(
    "w12_balanced_row_windows",
    sql(
        "SELECT idx AS end_idx, 1 AS label FROM anyl WHERE gt_detection_win UNION ALL "
        f"SELECT end_idx, 0 FROM (SELECT idx AS end_idx FROM anyl WHERE a = 0 ORDER BY {HASH.format('idx')}, idx "
        "LIMIT (SELECT count(*) FROM anyl WHERE gt_detection_win))",
        FLAGGED_SQL,
    ),
)
def w12(spark, sf):
    s = windows.any_label(stream(spark, sf).select("idx", "gt_detection_win"), F.col("gt_detection_win"), SIZE, chunk(spark, sf))
    pos = s.filter(F.col("gt_detection_win")).select(F.col("idx").alias("end_idx"))
    quiet = s.filter("window_label = 0").select(F.col("idx").alias("start_idx"))
    neg = sampling.negative_starts(quiet, pos).select(F.col("start_idx").alias("end_idx"))
    return pos.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0)))


ZONE_SQL = """
zone AS (SELECT s AS lo, e AS hi FROM dr UNION SELECT greatest(start_idx - 50, 0), start_idx + 59 + 49 FROM posw)"""
ZONEB_SQL = """
zone AS (SELECT DISTINCT greatest(start_idx - 50, 0) AS lo, start_idx + 60 + 49 AS hi FROM posw)"""
FREE_SQL = """
free AS (SELECT idx AS start_idx FROM st WHERE idx + 60 <= (SELECT count(*) FROM st)
         AND NOT EXISTS (SELECT 1 FROM zone WHERE idx <= hi AND idx + 59 >= lo))"""
NEG_SQL = f"""
neg AS (SELECT start_idx FROM free ORDER BY {HASH.format('start_idx')}, start_idx LIMIT (SELECT count(*) FROM posw)),
bal AS (SELECT row_number() OVER (ORDER BY start_idx, event_sclk) - 1 AS window_id, * FROM (
  SELECT start_idx, sclk AS event_sclk, 1 AS label FROM posw UNION ALL SELECT start_idx, -1, 0 FROM neg))"""


def zones(spark, sf, flags=True):
    return sampling.forbidden_intervals(stream(spark, sf), positives(spark, sf), SIZE, 50, flags, chunk(spark, sf))


@query(
    "w14_forbidden_zones",
    sql("SELECT count(DISTINCT idx) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM st JOIN zone ON idx BETWEEN lo AND hi", DET_RUNS, POS_SQL, ZONE_SQL),
)
def w14(spark, sf):
    marked = flag_inside(stream(spark, sf).select("idx"), merged_by_bin(zones(spark, sf), "lo", "hi"), "idx", "hit")
    return marked.filter("hit").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query("w14b_forbidden_zones_gating", sql("SELECT lo, hi FROM zone", DET_RUNS, POS_SQL, ZONEB_SQL))
def w14b(spark, sf):
    return zones(spark, sf, flags=False).select("lo", "hi")


@query("j13_free_window_starts", sql("SELECT start_idx FROM free", DET_RUNS, POS_SQL, ZONE_SQL, FREE_SQL))
def j13(spark, sf):
    return sampling.free_starts(stream(spark, sf), zones(spark, sf), SIZE)


@query(
    "n1_negative_shortfall",
    sql(
        f"SELECT wanted, available, least(wanted, available) AS drawn, wanted - least(wanted, available) AS shortfall FROM (SELECT {i8('count(*) * 1000', 'wanted')} FROM posw), (SELECT count(*) AS available FROM free)",
        DET_RUNS, POS_SQL, ZONE_SQL, FREE_SQL,
    ),
)
def n1b(spark, sf):
    """A thousand negatives for each positive are more than there is room for."""
    pos = materialise(positives(spark, sf))
    return sampling.negative_report(sampling.free_starts(stream(spark, sf), zones(spark, sf), SIZE), pos, 1000.0)


@query("n1_negative_windows", sql("SELECT start_idx FROM neg", DET_RUNS, POS_SQL, ZONE_SQL, FREE_SQL, NEG_SQL))
def n1(spark, sf):
    _, negatives = sampling.training_sample(stream(spark, sf), catalogue(spark, sf), SIZE, chunk=chunk(spark, sf))
    return negatives.select("start_idx")


def balanced(spark, sf):
    """Training windows of both classes: window_id, start_idx, event_sclk, label."""
    return sampling.training_windows(stream(spark, sf), catalogue(spark, sf), SIZE, chunk=chunk(spark, sf))


@query(
    "n2_combined_windows",
    sql("SELECT window_id, start_idx, event_sclk, label FROM bal", DET_RUNS, POS_SQL, ZONE_SQL, FREE_SQL, NEG_SQL),
)
def n2(spark, sf):
    return balanced(spark, sf).select("window_id", "start_idx", "event_sclk", "label")


def balanced_features(spark, sf, variant="A"):
    rows = windows.windows_from(stream(spark, sf).select("idx", "pressure"), balanced(spark, sf), SIZE)
    return ft.window_features(rows, train_stats(spark, sf), ["window_id", "event_sclk", "label"], variant, SIZE)


BAL_LONG = """
wl AS (SELECT window_id, idx - start_idx AS pos, pressure, idx FROM bal JOIN st ON idx BETWEEN start_idx AND start_idx + 59)"""


@query(
    "n2_training_features_a",
    sql(
        feature_sql("A", "wf JOIN bal USING (window_id)", "window_id, event_sclk, label,"),
        SPLIT_SQL, STATS_SQL, DET_RUNS, POS_SQL, ZONE_SQL, FREE_SQL, NEG_SQL, BAL_LONG, BASE_SQL,
    ),
)
def training_features(spark, sf):
    """W7 + W14 + J13 + N1 + N2 + F1–F16: the balanced training table, end to end."""
    return rounded(balanced_features(spark, sf), "A", "window_id", "event_sclk", "label")


@query(
    "n3_balanced_sample",
    sql(
        "SELECT window_id, y, 'test_fixed_' || lpad(CAST(row_number() OVER (ORDER BY window_id) - 1 AS VARCHAR), 6, '0') AS fixed_id FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY y ORDER BY {HASH.format('window_id')}, window_id) AS rn FROM sc) "
        "WHERE rn <= least(100, (SELECT min(c) FROM (SELECT count(*) AS c FROM sc GROUP BY y)))"
    ),
)
def n3(spark, sf):
    """N3 + X13: equal classes out of the scored windows, with new ids."""
    picked = sampling.balance(scored(spark, sf).select("window_id", "y"), "window_id", "y", per_class=100)
    numbered = renumber(picked, "n", by="window_id", chunk=chunk(spark, sf))
    return numbered.select("window_id", "y", F.format_string("%s_fixed_%06d", F.lit("test"), "n").alias("fixed_id"))


@query(
    "n4_undersample",
    sql(
        "SELECT window_id, y FROM (SELECT window_id, y FROM sc WHERE y = 1) UNION ALL "
        f"SELECT window_id, y FROM (SELECT window_id, y FROM sc WHERE y = 0 ORDER BY {HASH.format('window_id')}, window_id "
        "LIMIT (SELECT count(*) FROM sc WHERE y = 1))"
    ),
)
def n4(spark, sf):
    """All positives and as many hash-drawn negatives."""
    picked = sampling.balance(scored(spark, sf).select("window_id", "y"), "window_id", "y")
    return picked.select("window_id", "y")


@query(
    "n5_capacity",
    sql(
        "SELECT n AS total_rows, f AS forbidden_rows, n - f AS safe_rows, (n - f) // 60 AS window_capacity, "
        f"(SELECT count(*) FROM posw) AS positives, {q6('((n - f) // 60) / (SELECT count(*) FROM posw)', 'capacity_ratio')} FROM "
        "(SELECT count(*) AS n FROM st), (SELECT count(DISTINCT idx) AS f FROM st JOIN zone ON idx BETWEEN lo AND hi)",
        DET_RUNS,
        POS_SQL,
        ZONE_SQL,
    ),
)
def n5(spark, sf):
    out = sampling.capacity(stream(spark, sf), positives(spark, sf), zones(spark, sf), SIZE)
    return out.select(
        "total_rows", "forbidden_rows", "safe_rows", "window_capacity", "positives", r6("capacity_ratio", "capacity_ratio")
    )


@query(
    "n6_hash_sample",
    sql(f"SELECT idx, pressure FROM ev ORDER BY {HASH.format('idx')}, idx LIMIT 500"),
)
def n6(spark, sf):
    return sampling.sample_by_hash(stream(spark, sf).select("idx", "pressure"), "idx", 500)


@query(
    "s10_nested_windows",
    sql(
        "SELECT idx // 60 AS window_id, count(*) AS n, '[' || string_agg('{\"pos\":' || (idx % 60) || ',\"sclk\":' || sclk || '}', ',' ORDER BY idx) || ']' AS window_json "
        "FROM ev GROUP BY 1"
    ),
)
def s10(spark, sf):
    nested = windows.nested_windows(windows.tumbling(stream(spark, sf).select("idx", "sclk"), SIZE), ["window_id"], ["sclk"])
    return nested.select("window_id", big(F.size("window_data"), "n"), F.to_json("window_data").alias("window_json"))


@query("s10_nested_read_back", sql("SELECT idx // 60 AS window_id, idx % 60 AS pos, sclk, round(pressure, 6) + 0.0 AS pressure FROM ev"))
def s10b(spark, sf):
    """Nested windows written as JSON text, read back and opened again."""
    rows = windows.tumbling(stream(spark, sf).select("idx", "sclk", "pressure"), SIZE)
    nested = windows.nested_windows(rows, ["window_id"], ["sclk", "pressure"])
    stored = materialise(nested.select("window_id", F.to_json("window_data").alias("window_json")))
    back = windows.opened_windows(stored, "window_json", "pos bigint, sclk bigint, pressure double")
    return back.select("window_id", "pos", "sclk", r6("pressure", "pressure"))


@query(
    "m4b_stratified_split",
    sql(
        "SELECT window_id, CASE WHEN rn <= floor(c * 0.8) THEN 'train' ELSE 'test' END AS part FROM ("
        f"SELECT window_id, row_number() OVER (PARTITION BY y ORDER BY {HASH.format('window_id')}, window_id) AS rn, count(*) OVER (PARTITION BY y) AS c FROM sc)"
    ),
)
def m4b(spark, sf):
    return sampling.stratified_split(scored(spark, sf).select("window_id", "y"), "window_id", "y").select("window_id", "part")
