"""Streaming twins, replayed to completion over the event log and compared with their batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.base import big, q6, query, r6, sql, table
from tidemark.plans.q_features import feature_sql
from tidemark.sources.adapters import epoch_seconds
from tidemark.streaming import continuous, stateful
from tidemark.streaming.source import event_stream, run_available, run_to_end

# Channels are short in the test tables (about 67 readings), hence windows of 20.
N, STEP, G_MEAN, G_STD = 20, 5, 50.0, 50.0

CH_SQL = "ch AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY idx) - 1 AS k, event_id AS id FROM ev)"
# Readings that the watermark (the newest time, to the millisecond) has passed.
PASSED = "event_id IN (SELECT event_id FROM events WHERE ts < (SELECT date_trunc('millisecond', max(ts)) FROM events))"
PASSED_SQL = f"ch AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY idx) - 1 AS k, event_id AS id FROM ev WHERE {PASSED})"
WIN_SQL = [
    PASSED_SQL,
    f"wk AS (SELECT channel, (k - {N - 1}) // {STEP} AS window_id, k, id AS end_id FROM ch WHERE k >= {N - 1} AND (k - {N - 1}) % {STEP} = 0)",
    f"wl AS (SELECT wk.channel * 1000000 + wk.window_id AS wkey, o AS pos, ch.pressure FROM wk, (SELECT unnest(range({N})) AS o) JOIN ch ON ch.channel = wk.channel AND ch.k = wk.k - {N - 1} + o)",
    "wm AS (SELECT wkey, min(pressure) AS mn FROM wl GROUP BY 1)",
    "wa AS (SELECT wl.wkey, min(pos) AS arg FROM wl JOIN wm ON wl.wkey = wm.wkey AND pressure = mn GROUP BY 1)",
    f"wb AS (SELECT wkey, avg(pressure) AS mean, stddev_pop(pressure) AS std, min(pressure) AS mn, max(pressure) AS mx, regr_slope(pressure, pos) AS slope, "
    f"regr_slope(CASE WHEN pos < {N // 2} THEN pressure END, pos) AS s1, regr_slope(CASE WHEN pos >= {N // 2} THEN pressure END, pos) AS s2, "
    f"avg(CASE WHEN pos < {N // 2} THEN pressure END) AS m1, avg(CASE WHEN pos >= {N // 2} THEN pressure END) AS m2, max(CASE WHEN pos = 0 THEN pressure END) AS first_p FROM wl GROUP BY 1)",
    f"wf AS (SELECT wk.channel, wk.window_id, wk.end_id, wb.*, arg, {G_MEAN} AS g_mean, {G_STD} AS g_std FROM wb JOIN wa USING (wkey) JOIN wk ON wkey = wk.channel * 1000000 + wk.window_id)",
]


@query("r2_live_sliding_features", sql(feature_sql("A", "wf", "channel, window_id, end_id,").replace("59.0", f"{N - 1}.0"), *WIN_SQL))
def r2(spark, sf):
    live = stateful.sliding_features(event_stream(spark, sf), N, STEP, G_MEAN, G_STD)
    out = run_available(live)
    return out.select("channel", "window_id", "end_id", *[r6(F.col(f) + (1e-9 if f == "drop_rate" else 0.0), f) for f in stateful.FEATURE_NAMES])


@query(
    "r1_newest_readings",
    sql(
        f"SELECT channel, id, k >= {N - 1} AS ready, {q6(f'CASE WHEN k >= {N - 1} THEN avg(pressure) OVER w END', 'mean')}, "
        f"{q6(f'CASE WHEN k >= {N - 1} THEN regr_slope(pressure, k) OVER w END', 'slope')} FROM ch WINDOW w AS (PARTITION BY channel ORDER BY k ROWS {N - 1} PRECEDING)",
        CH_SQL,
    ),
)
def r1(spark, sf):
    out = run_to_end(event_stream(spark, sf), lambda s, delay: stateful.newest_readings(s, N, delay))
    return out.select("channel", "id", "ready", r6("mean", "mean"), r6("slope", "slope"))


@query(
    "r3_live_vote",
    sql("SELECT channel, id, CASE WHEN sum(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY k ROWS 2 PRECEDING) >= 2 THEN 1 ELSE 0 END AS vote FROM ch", CH_SQL),
)
def r3(spark, sf):
    p = F.col("pressure") / (F.col("pressure") + 50.0)
    return run_to_end(event_stream(spark, sf), lambda s, delay: stateful.vote(s, p, 0.5, delay=delay)).select("channel", "id", "vote")


@query(
    "r4_live_latch",
    sql(
        "SELECT channel, outcome, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM (SELECT channel, id, CASE WHEN ev_ THEN CASE WHEN bool_or(d AND h) OVER (PARTITION BY channel, g ORDER BY k) THEN 'TP' ELSE 'FN' END "
        "WHEN h THEN 'FP' ELSE 'TN' END AS outcome FROM rn) GROUP BY 1, 2",
        CH_SQL,
        "fl4 AS (SELECT *, event_type = 'error' AS d, event_type IN ('error', 'click') AS ev_, p >= 0.4 AS h FROM ch)",
        "rn AS (SELECT *, sum(CASE WHEN ev_ IS DISTINCT FROM pe THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY k) AS g FROM (SELECT *, lag(ev_) OVER (PARTITION BY channel ORDER BY k) AS pe FROM fl4))",
    ),
)
def r4(spark, sf):
    """Precursor and event flags are stood in for by two event kinds."""
    p = F.col("pressure") / (F.col("pressure") + 50.0)
    kind = F.col("event_type")
    out = run_to_end(event_stream(spark, sf), lambda s, delay: stateful.latch(s, kind == "error", kind == "click", p >= 0.4, delay))
    return out.groupBy("channel", "outcome").agg(F.count(F.lit(1)).alias("n"), big(F.sum("id"), "id_sum"))


@query("r5_unique_clocks", sql("SELECT count(*) AS n, count(DISTINCT channel) AS channels FROM (SELECT DISTINCT channel, sclk FROM ev)"))
def r5(spark, sf):
    out = run_available(continuous.unique_clocks(event_stream(spark, sf)))
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("channel").alias("channels"))


@query(
    "r6_interval_counts",
    sql(
        "SELECT sclk // 3600 * 3600 AS start_sclk, count(*) AS n, 0::BIGINT AS nulls, min(pressure) AS min_pressure, max(pressure) AS max_pressure FROM ev "
        "GROUP BY 1 HAVING (max(sclk // 3600) + 1) * 3600 <= (SELECT max(sclk) FROM ev)"
    ),
)
def r6_(spark, sf):
    """Hours that the watermark has closed."""
    return run_available(continuous.interval_counts(event_stream(spark, sf), delay="0 seconds"))


@query(
    "r6_gap_sessions",
    sql(
        "SELECT channel, min(sclk) AS first_sclk, max(sclk) AS last_sclk, count(*) AS n FROM (SELECT *, sum(br) OVER (PARTITION BY channel ORDER BY ts, id) AS s FROM ("
        "SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY channel ORDER BY ts, id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS br FROM ct)) GROUP BY channel, s "
        "HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)",
        "ct AS (SELECT user_id AS channel, event_id AS id, ts, CAST(floor(epoch(ts)) AS BIGINT) AS sclk FROM events)",
    ),
)
def r6b(spark, sf):
    return run_available(continuous.gap_sessions(event_stream(spark, sf), gap="6 hours", delay="0 seconds"))


@query(
    "r7_live_interval_flags",
    sql("SELECT in_event, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM (SELECT event_id, EXISTS (SELECT 1 FROM cat WHERE ev.sclk BETWEEN cat.sclk - 600 AND cat.sclk + 300) AS in_event FROM ev) GROUP BY 1"),
)
def r7(spark, sf):
    e = table(spark, sf, "events")
    centres = e.filter((F.col("event_type") == "error") & (F.col("value") >= 200)).select(epoch_seconds(e, "ts").cast("long").alias("sclk"))
    static = continuous.clock_intervals(centres, 600, 300)
    out = run_available(continuous.flag_intervals(event_stream(spark, sf), static))
    return out.groupBy("in_event").agg(F.count(F.lit(1)).alias("n"), big(F.sum("id"), "id_sum"))
