"""Scan and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.scalars import catalogue_seconds
from tidemark.operators import metrics as m
from tidemark.operators import splits
from tidemark.operators import thresholds as th
from tidemark.plans.base import big, chunk, i8, q6, query, r6, scored, sql, stream, table
from tidemark.plans.q_features import SPLIT_SQL, ma500
from tidemark.plans.q_metrics import MODEL_SQL, RULE_GRID, TUNE, counts_sql, grid_cte, model_scores, rates_cte, sweep_cte
from tidemark.session import new_table
from tidemark.sources import links, readers, sinks


def scratch(spark) -> str:
    return new_table(spark)


def raw_rows(spark, sf):
    """The stream in the delivered CSV shape: text clocks (every 97th is broken) and text flags."""
    s = stream(spark, sf)
    clock = F.when(F.col("idx") % 97 == 0, F.lit("n/a")).otherwise(F.col("sclk").cast("string"))
    flag = lambda c: F.when(F.col(c), "True").otherwise("False")
    return s.select(
        clock.alias("SCLK"), F.col("pressure").alias("PRESSURE"), "sol", F.lit("12:00:00").alias("time"),
        flag("gt_fwhm").alias("gt_fwhm"), F.lit(None).cast("int").alias("gt_vortex_ind"),
        flag("gt_detection_win").alias("gt_detection_win"), flag("gt_4xfwhm").alias("gt_4xfwhm"),
        F.lit(None).cast("double").alias("PRESSURE_MA_500"),
    )


@query(
    "s1_s5_s8_csv_clean_load",
    sql(
        f"SELECT sol, count(*) AS n, {q6('sum(pressure)', 'total')}, {i8('sum(CASE WHEN gt_detection_win THEN 1 ELSE 0 END)', 'positives')} FROM st WHERE idx % 97 <> 0 GROUP BY 1"
    ),
)
def s1(spark, sf):
    """S1 + S4 + S5 + S8: write the raw CSV, read it back typed, check, clean, normalise."""
    path = scratch(spark)
    sinks.write_csv(raw_rows(spark, sf), path)
    df = readers.clean(readers.validated(readers.read_csv(spark, path, schemas.RAW_STREAM)))
    return df.groupBy("sol").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("PRESSURE"), "total"), big(F.sum(F.col("gt_detection_win").cast("int")), "positives")
    )


@query(
    "s5_clean_report",
    sql("SELECT count(*) AS total_rows, count(*) FILTER (WHERE idx % 97 = 0) AS dropped_rows, count(*) FILTER (WHERE idx % 97 <> 0) AS kept_rows FROM ev"),
)
def s5(spark, sf):
    return readers.clean_report(raw_rows(spark, sf))


@query("s2_projected_scan", "SELECT event_id, value FROM events")
def s2(spark, sf):
    return table(spark, sf, "events").select("event_id", "value")


@query("s3_first_rows", sql("SELECT idx, sclk, pressure FROM ev ORDER BY idx LIMIT 100"))
def s3(spark, sf):
    """First rows of the ordered stream: a filter on position, pushed to the scan."""
    return stream(spark, sf).filter(F.col("idx") < 100).select("idx", "sclk", "pressure")


@query("s7_source_fallback", "SELECT count(*) AS n FROM events")
def s7(spark, sf):
    df = readers.read_first_available(spark, [f"{sf}/no_such_table.parquet", f"{sf}/events.parquet"])
    return df.agg(F.count(F.lit(1)).alias("n"))


@query(
    "s9_split_partitioned_table",
    sql("SELECT 'val' AS split, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM sp WHERE split = 'val'", SPLIT_SQL),
)
def s9(spark, sf):
    """Write one folder per split, then read a single split back through partition pruning."""
    path = scratch(spark)
    sinks.write_by_split(splits.position_split(stream(spark, sf)), path)
    val = spark.read.parquet(path).filter("split = 'val'")
    return val.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query(
    "s6_s11_run_records",
    sql(f"SELECT 'b' AS run_id, {q6('t', 'threshold')}, {q6('f1', 'value')} FROM sw", *sweep_cte(RULE_GRID)),
)
def s6(spark, sf):
    """S6 + S11: record the sweep under two runs, then read the newest one's F1 rows."""
    path = scratch(spark)
    rates = m.with_rates(m.sweep(scored(spark, sf), RULE_GRID))
    sinks.record_metrics(m.with_rates(m.sweep(scored(spark, sf), RULE_GRID[:3])), path, "a", 100, "sweep")
    sinks.record_metrics(rates, path, "b", 200, "sweep")
    newest = sinks.latest_run(spark.read.schema(schemas.RUN_RECORD).parquet(path), "sweep")
    return newest.filter("metric = 'f1'").select("run_id", r6("threshold", "threshold"), r6("value", "value"))


@query(
    "s11_t26_threshold_from_run_table",
    sql(
        f"SELECT model, {q6('t', 'threshold')}, {i8('tp', 'tp')}, {i8('fp', 'fp')} FROM r",
        *TUNE,
        f"tc AS (SELECT model, t, {counts_sql('p >= t')} FROM msp JOIN tuned USING (model) WHERE split = 'test' GROUP BY 1, 2)",
        rates_cte("tc", "r", "model, t,"),
    ),
)
def s11(spark, sf):
    """Validation results go to the run table; the test split is scored once at what it holds."""
    path = scratch(spark)
    s = model_scores(spark, sf)
    sinks.record_metrics(m.with_rates(m.sweep(s.filter("split = 'val'"), th.COST_GRID, by=["model"])), path, "v", 1, "validation")
    runs = spark.read.schema(schemas.RUN_RECORD).parquet(path)
    tuned = sinks.best_recorded_threshold(sinks.latest_run(runs, "validation")).withColumnRenamed("name", "model")
    out = th.frozen_test(s.filter("split = 'test'"), tuned)
    return out.select("model", r6("threshold", "threshold"), big("tp", "tp"), big("fp", "fp"))


@query(
    "s12_feature_cache",
    sql(f"SELECT count(*) AS n, {q6('avg(ma500)', 'mean_ma500')} FROM (SELECT avg(pressure) OVER (ORDER BY idx ROWS 499 PRECEDING) AS ma500 FROM ev)"),
)
def s12(spark, sf):
    """Built and saved by the first call, reused by the second because the length fits."""
    path = scratch(spark)
    rows = stream(spark, sf).count()
    sinks.cached_features(spark, path, rows, lambda: ma500(spark, sf).select("idx", "ma500"))
    again = sinks.cached_features(spark, path, rows, lambda: spark.range(0).select(F.col("id").alias("idx")))
    return again.agg(F.count(F.lit(1)).alias("n"), r6(F.avg("ma500"), "mean_ma500"))


@query(
    "x8_x9_feature_projection",
    sql("SELECT window_id, end_idx FROM wend"),
)
def x8(spark, sf):
    """X8 + X9: training columns that exist, in training order, without the leaking one."""
    from tidemark.plans.q_aggregates import window_table

    df, missing = readers.select_features(
        window_table(spark, sf).drop("start_sclk"), ["window_id", "end_idx", "event_sclk", "no_such"], exclude=("event_sclk",)
    )
    assert missing == ["no_such"]
    return df


@query(
    "x13_catalogue_time",
    sql("SELECT vortex, sclk - (sclk // 86400) * 86400 + (sclk // 86400 - 19000) * 86400 AS seconds FROM cat"),
)
def catalogue_time(spark, sf):
    """Catalogue text ``SSSS HH:MM:SS`` to seconds, on times written out from the stream's clock."""
    from tidemark.plans.base import catalogue

    s, d = F.col("sclk"), F.floor(F.col("sclk") / 86400)
    rest = s - d * 86400
    text = F.format_string(
        "%04d %02d:%02d:%02d", d - 19000, F.floor(rest / 3600), F.floor(rest % 3600 / 60), rest % 60
    )
    return catalogue(spark, sf).select("vortex", catalogue_seconds(text).alias("seconds"))


LINKS_SQL = r"""
lk AS (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS raw FROM (SELECT page_id,
        regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'),
        '(?i)<a\s(?:[^>"'']|"[^"]*"|''[^'']*'')*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1) AS h FROM pages)),
lh AS (SELECT page_id, pos, replace(trim(regexp_replace(raw, '^["'']|["'']$', '', 'g')), '&amp;', '&') AS href FROM lk)"""


@query(
    "s13_page_links",
    f"WITH {LINKS_SQL.strip()} SELECT page_id, CAST(pos AS BIGINT) AS pos, href, NOT (href IN ('', '../') OR href LIKE '/%' OR href LIKE '?%' OR href LIKE '#%' OR href LIKE 'icons/%') AS is_child, href LIKE '%/' AS is_dir FROM lh",
)
def s13(spark, sf):
    return links.extract_links(table(spark, sf, "pages")).withColumn("pos", F.col("pos").cast("long"))


@query(
    "s13_child_links",
    f"WITH {LINKS_SQL.strip()}, ch AS (SELECT page_id, CAST(pos AS BIGINT) AS pos, substr(href, 2) AS href FROM lh) "
    "SELECT page_id, pos, href FROM ch WHERE NOT (href IN ('', '../') OR href LIKE '/%' OR href LIKE '?%' OR href LIKE '#%' OR href LIKE 'icons/%') AND lower(href) LIKE '%e'",
)
def s13b(spark, sf):
    """Child entries once the leading slash of these pages' links is taken off; files that end in ``e``."""
    pages = table(spark, sf, "pages").withColumn("html", F.replace(F.col("html"), F.lit('href="/'), F.lit('href="')))
    return links.child_links(pages, extensions=["E"]).select("page_id", F.col("pos").cast("long").alias("pos"), "href")
