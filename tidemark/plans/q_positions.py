"""Index, splits, filters and other position queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions.scalars import as_flag, strict_label
from tidemark.operators import splits
from tidemark.operators.intervals import neighbourhood
from tidemark.plans.base import big, catalogue, i8, q6, query, r6, raw_stream, scored, sql, stream, table, wends
from tidemark.session import new_table
from tidemark.sources.adapters import epoch_seconds
from tidemark.sources.growing import GrowingIndex


@query("x2_dense_index", sql("SELECT event_id, idx, sclk FROM ev"))
def x2(spark, sf):
    """X1/X2: position of every sample in clock order."""
    return raw_stream(spark, sf).select("event_id", "idx", "sclk")


@query("x2_growing_index", sql("SELECT event_id, idx, sclk FROM ev"))
def x2b(spark, sf):
    """The same positions from three appends; the last overlaps the end of the second."""
    e = table(spark, sf, "events").select("event_id", "ts")
    cut = e.agg(F.percentile_approx("ts", F.array(F.lit(0.5), F.lit(0.9))).alias("c"))
    first, second = cut.first()["c"]
    index = GrowingIndex(spark, new_table(spark), "ts", "event_id")
    recent = (F.col("ts") > first) & (F.col("event_id") % 10 != 3)
    for rows in (e.filter(F.col("ts") <= first), e.filter(recent & (F.col("ts") <= second)), e.filter((F.col("ts") > first) & ~(recent & (F.col("ts") <= second)))):
        index.append(rows)
    out = index.read()
    return out.select("event_id", "idx", epoch_seconds(out, "ts").cast("long").alias("sclk"))


SPLIT_SQL = """
cnt AS (SELECT count(*) AS n FROM ev),
sp AS (
  SELECT st.*, CASE WHEN idx < floor(n * 0.70) THEN 'train'
    WHEN idx >= floor(n * (0.70 + 0.035)) AND idx < floor(n * (0.70 + 0.035 + 0.15)) THEN 'val'
    WHEN idx >= floor(n * (0.70 + 2 * 0.035 + 0.15)) THEN 'test' END AS split FROM st, cnt)"""
SPLIT60_SQL = (
    SPLIT_SQL.replace("0.70", "CAST(0.6 AS DOUBLE)")
    .replace("0.035", "CAST(0.005 AS DOUBLE)")
    .replace("0.15", "CAST(0.15 AS DOUBLE)")
)
SPLIT_SQL = (
    SPLIT_SQL.replace("0.70", "CAST(0.7 AS DOUBLE)")
    .replace("0.035", "CAST(0.035 AS DOUBLE)")
    .replace("0.15", "CAST(0.15 AS DOUBLE)")
)


@query("x3_split_70", sql("SELECT idx, split FROM sp WHERE split IS NOT NULL", SPLIT_SQL))
def x3(spark, sf):
    return splits.position_split(stream(spark, sf), splits.SPLIT_70).select("idx", "split")


@query("x3_split_60", sql("SELECT idx, split FROM sp WHERE split IS NOT NULL", SPLIT60_SQL))
def x3b(spark, sf):
    return splits.position_split(stream(spark, sf), splits.SPLIT_60).select("idx", "split")


def _nogap(train: float, val: float) -> str:
    a, b = f"CAST({train} AS DOUBLE)", f"CAST({val} AS DOUBLE)"
    return f"""
SELECT split, count(*) AS n_rows, min(idx) AS first_idx, max(idx) AS last_idx FROM (
  SELECT idx, CASE WHEN idx < floor(n * {a}) THEN 'train' WHEN idx < floor(n * ({a} + {b})) THEN 'val' ELSE 'test' END AS split
  FROM ev, (SELECT count(*) AS n FROM ev)) GROUP BY 1"""


@query("x4_chronological_split", sql(_nogap(0.6, 0.2)))
def x4(spark, sf):
    s = splits.chronological_split(stream(spark, sf), 0.6, 0.2)
    return s.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")
    )


@query("x5_clock_range", sql("SELECT idx, sclk, pressure FROM ev WHERE sclk BETWEEN 1704153600 AND 1704326400"))
def x5(spark, sf):
    return stream(spark, sf).filter(F.col("sclk").between(1704153600, 1704326400)).select("idx", "sclk", "pressure")


@query("x6_label_to_int", sql("SELECT window_id, CAST(y AS BIGINT) AS y FROM sc"))
def x6(spark, sf):
    """X6: drop Omit, then the strict map that fails on any other text."""
    w = scored(spark, sf, omit=True).filter(F.col("label") != "Omit")
    return w.select("window_id", strict_label(F.col("label")).cast("long").alias("y"))


@query(
    "x7_boolean_normalise",
    sql(
        f"SELECT raw, {i8('count(*)', 'n')}, {i8('sum(CASE WHEN flag THEN 1 ELSE 0 END)', 'n_true')} FROM "
        "(SELECT raw, coalesce(lower(raw) IN ('true', '1', '1.0'), false) AS flag FROM "
        "(SELECT CASE idx % 5 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN 'false' WHEN 3 THEN 'other' END AS raw FROM ev)) "
        "GROUP BY raw"
    ),
)
def x7(spark, sf):
    i = F.col("idx") % 5
    raw = F.when(i == 0, "True").when(i == 1, "1").when(i == 2, "false").when(i == 3, "other")
    return (
        stream(spark, sf)
        .select(raw.alias("raw"))
        .withColumn("flag", as_flag(F.col("raw")))
        .groupBy("raw")
        .agg(F.count(F.lit(1)).alias("n"), big(F.sum(F.col("flag").cast("int")), "n_true"))
    )


@query("x10_threshold", sql("SELECT window_id, p >= 0.5 AS hit, p > 0.5 AS hit_strict FROM sc"))
def x10(spark, sf):
    return scored(spark, sf).select(
        "window_id", (F.col("p") >= 0.5).alias("hit"), (F.col("p") > 0.5).alias("hit_strict")
    )


@query(
    "x11_neighbourhood",
    sql(
        "SELECT vortex, idx, idx - centre AS rel_pos, (idx - centre) / 3600.0 AS rel_hours, pressure FROM cat JOIN ev "
        "ON idx BETWEEN centre - 7200 AND centre + 7200"
    ),
)
def x11(spark, sf):
    near = neighbourhood(raw_stream(spark, sf), catalogue(spark, sf).select("vortex", "centre"), "centre", 7200, 7200)
    return near.select("vortex", "idx", "rel_pos", (F.col("rel_pos") / 3600.0).alias("rel_hours"), "pressure")


@query(
    "x12_distinct",
    sql(
        "SELECT count(DISTINCT channel) AS channels, count(DISTINCT sol) AS sols, count(DISTINCT sclk) AS clocks, "
        "(SELECT count(*) FROM (SELECT DISTINCT channel, event_type FROM ev)) AS pairs FROM ev"
    ),
)
def x12(spark, sf):
    s = stream(spark, sf)
    pairs = s.select("channel", "event_type").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    counts = s.agg(
        F.countDistinct("channel").alias("channels"),
        F.countDistinct("sol").alias("sols"),
        F.countDistinct("sclk").alias("clocks"),
    )
    return attach(counts, pairs)


@query("x13_ids", sql("SELECT window_id, 'test_fixed_' || lpad(CAST(window_id AS VARCHAR), 6, '0') AS fixed_id FROM wend"))
def x13(spark, sf):
    return wends(spark, sf).select(
        "window_id", F.format_string("%s_fixed_%06d", F.lit("test"), "window_id").alias("fixed_id")
    )


@query(
    "q1_isolation",
    sql(
        f"SELECT split, n_rows, has_overlap, {q6('CASE WHEN gap > 0 THEN gap / 3600.0 ELSE 0.0 END', 'gap_hours')} FROM ("
        "SELECT *, coalesce(lo - lag(hi) OVER (ORDER BY lo_i) <= 0, false) AS has_overlap, lo - lag(hi) OVER (ORDER BY lo_i) AS gap "
        "FROM (SELECT split, count(*) AS n_rows, min(idx) AS lo_i, min(sclk) AS lo, max(sclk) AS hi FROM sp "
        "WHERE split IS NOT NULL GROUP BY 1))",
        SPLIT_SQL,
    ),
)
def q1(spark, sf):
    r = splits.isolation_report(splits.position_split(stream(spark, sf)))
    return r.select("split", F.col("rows").alias("n_rows"), F.col("overlaps").alias("has_overlap"), r6("gap_hours", "gap_hours"))


@query(
    "j4_events_by_split",
    sql(
        "SELECT vortex, b.split FROM cat JOIN (SELECT split, min(sclk) AS lo, max(sclk) AS hi FROM sp "
        "WHERE split IS NOT NULL GROUP BY 1) b ON cat.sclk BETWEEN lo AND hi",
        SPLIT_SQL,
    ),
)
def j4(spark, sf):
    s = splits.position_split(stream(spark, sf))
    return splits.events_by_split(catalogue(spark, sf), s).select("vortex", "split")
