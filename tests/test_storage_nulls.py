"""Scratch folders, the stored stream's order, null readings, correlations with gaps, model operators."""

from __future__ import annotations

import math
import os
import types

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_TINY
from tidemark import session
from tidemark.operators import aggregates as ag
from tidemark.operators import audit, features as ft, legacy, metrics, ml, windows
from tidemark.operators.intervals import flag_around, flag_ordered
from tidemark.plans import base


def test_scratch_without_a_setting(spark, monkeypatch):
    monkeypatch.setattr(session, "SCRATCH_CONFS", ("spark.tidemark.unset",))
    assert os.path.isdir(os.path.dirname(session.scratch_root(spark)))
    context = types.SimpleNamespace(applicationId="app", master="spark://host:7077")
    elsewhere = types.SimpleNamespace(sparkContext=context, conf=spark.conf)
    with pytest.raises(RuntimeError, match="all executors share"):
        session.scratch_root(elsewhere)


def test_scratch_setting_at_run_time(spark, tmp_path):
    spark.conf.set("spark.tidemark.scratch", str(tmp_path))
    try:
        assert session.scratch_root(spark).startswith(str(tmp_path))
    finally:
        spark.conf.unset("spark.tidemark.scratch")


def test_scope_deletes_its_tables_and_forgets_them(spark):
    before = base.stream(spark, SF_TINY).count()
    with session.scratch(spark) as folder:
        stored = base.stored(spark, SF_TINY, "scoped", lambda: session.materialise(spark.range(5)))
        assert stored.count() == 5 and os.path.isdir(folder.removeprefix("file:"))
    assert not os.path.exists(folder.removeprefix("file:"))
    assert not any(k[2] == "scoped" for k in base._STORED)
    assert base.stream(spark, SF_TINY).count() == before  # index tables stay


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    events = spark.read.parquet(f"{SF_TINY}/events.parquet")
    events.limit(50).write.parquet(f"{tmp_path}/events.parquet")
    assert base.stream(spark, str(tmp_path)).count() == 50
    events.limit(60).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert base.stream(spark, str(tmp_path)).count() == 60


FLAGS = {"near": (-2, 2), "ahead": (-12, -3), "after": (1, 4)}


def test_ordered_flags_equal_the_join_and_keep_files_apart(spark, make_stream):
    s = make_stream(range(500)).drop("gt_detection_win", "gt_fwhm", "gt_4xfwhm")
    at = {0, 1, 17, 60, 63, 64, 250, 499}
    centres = spark.createDataFrame([(c,) for c in at], "centre bigint")
    ordered = flag_ordered(s, F.col("idx").isin(*at), FLAGS, chunk=64)
    got = [tuple(r) for r in ordered.orderBy("idx").collect()]
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert got == [tuple(r) for r in flag_around(s, centres, FLAGS).orderBy("idx").collect()]
        stored = session.materialise(ordered)
        ranges = stored.groupBy(F.input_file_name()).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi")).orderBy("lo").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, (a, b) in FLAGS.items():
        k = ordered.columns.index(name)
        assert [r[k] for r in got] == [any(a <= i - c <= b for c in at) for i in range(500)]
    assert len(ranges) > 1 and all(x.hi < y.lo for x, y in zip(ranges, ranges[1:]))


@pytest.mark.parametrize("variant", ["A", "B", "C", "D"])
def test_windows_with_a_null_reading_are_dropped_everywhere(spark, make_stream, variant):
    values = [700 + 5 * math.sin(i / 7) + i % 3 for i in range(400)]
    values[205] = 600.0  # a minimum next to a null
    holes = {60, 129, 204, 390}  # first row of a window, last row of one, beside the minimum
    s = make_stream(values).withColumn("pressure", F.when(~F.col("idx").isin(*holes), F.col("pressure")))
    stats = ft.global_stats(s)
    want = [k for k in range(35) if not any(10 * k <= h < 10 * k + 60 for h in holes)]
    panes = ft.sliding_features(s, stats, variant, 60, 10).orderBy("window_id").toPandas()
    assert panes.window_id.tolist() == want
    rows = windows.explode_windows(s, 60, 10).select("window_id", "pos", "pressure")
    other = ft.window_features(rows, stats, ["window_id"], variant).orderBy("window_id").toPandas()
    assert other.window_id.tolist() == want
    for f in ft.features_of(variant):
        assert panes[f].tolist() == pytest.approx(other[f].tolist(), abs=1e-6)
    arrays = windows.window_arrays(s, 60, 10)
    assert sorted((r.end_idx - 59) // 10 for r in arrays.collect()) == want


def test_correlations_with_gaps_constants_and_empty_columns(spark):
    rows = [(float(i), 2.0 * i + (i % 5), None if i % 3 else float(-i), float("nan") if i == 4 else float(i * i), 1.0, None) for i in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, one double, none double")
    r = {(x.f1, x.f2): x.r for x in ag.correlation_matrix(df, df.columns).collect()}
    assert len(r) == 15 and r["a", "c"] == pytest.approx(-1.0)
    pdf = df.toPandas()
    assert r["a", "d"] == pytest.approx(pdf.a.corr(pdf.d)) and r["b", "c"] == pytest.approx(pdf.b.corr(pdf.c))
    assert all(v is None for k, v in r.items() if "one" in k or "none" in k)
    kinds = {(x.kind, x.subject) for x in audit.matrix_warnings(df, df.columns).collect()}
    assert {("nan", "none"), ("nan", "c"), ("nan", "d"), ("constant", "one"), ("correlated", "a~c")} <= kinds


def test_smoothing_reads_the_nearest_parabola_at_the_ends(spark, make_stream):
    import numpy as np

    values = [float((i * 37) % 11) for i in range(40)]
    got = legacy.savgol(make_stream(values), (5, 11), chunk=16).orderBy("idx").toPandas()
    for n in (5, 11):
        h = n // 2
        for i in range(40):
            c = min(max(i, h), 39 - h)
            fit = np.polyfit(np.arange(-h, h + 1), values[c - h : c + h + 1], 2)
            assert got[f"smooth_{n}"][i] == pytest.approx(np.polyval(fit, i - c), abs=1e-8)


def test_percentiles_of_ten_thousand_groups(spark):
    from tidemark.operators.index import exact_percentiles

    df = spark.range(60_000).select((F.col("id") % 10_000).alias("g"), F.when(F.col("id") % 9 != 4, F.hash("id") % 1000 / 7).alias("v"))
    qs = [0.0, 0.5, 0.9, 1.0]
    out = exact_percentiles(df, "v", qs, by="g")
    # Only summaries of range partitions meet in one task, never groups or values.
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    got = {(r.g, r.q): r.v for r in out.collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("p")).collect()
    assert len(got) == sum(4 for r in want if r.p is not None)
    for r in want:
        if r.p is not None:
            assert [got[r.g, q] for q in qs] == pytest.approx(list(r.p))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, i, float(i % 10), float((i * 7) % 13), int(i % 10 > 6)) for i in range(400)]
    return spark.createDataFrame(rows, "window_id bigint, end_idx bigint, a double, b double, y int")


def test_models_learn_a_simple_rule(labelled):
    train, val = labelled.filter("end_idx < 300"), labelled.filter("end_idx >= 300")
    f = ["a", "b"]
    models = {"forest": ml.forest(f, trees=5, depth=4).fit(ml.balanced_weights(train)), "boosted": ml.fit_boosted(train, val, f, rounds=5)}
    for model in models.values():
        r = metrics.with_rates(metrics.confusion(ml.score(model, val), F.col("p") >= 0.5)).first()
        assert r.f1 > 0.95 and r.tp + r.fn == 30
    top = ml.importance_table(models["forest"], f, labelled.sparkSession).orderBy("place").collect()
    assert top[0].feature == "a" and sum(x.importance for x in top) == pytest.approx(1.0)
    drops = {x.feature: x.mean_drop for x in ml.permutation_importance(models["forest"], val, f).collect()}
    assert drops["a"] > 0.1 > abs(drops["b"])


def test_grid_search_over_either_kind(labelled):
    train, val = labelled.filter("end_idx < 300"), labelled.filter("end_idx >= 300")
    for kind, grid in (("forest", [{"trees": 3, "depth": d} for d in (1, 4)]), ("boosted", [{"rounds": 2, "depth": d, "rate": 0.3} for d in (1, 3)])):
        model, results = ml.grid_search(train, val, ["a", "b"], grid, kind=kind)
        assert results.count() == 2 and results.first().f1 == max(r.f1 for r in results.collect())
        assert ml.score(model, val).count() == 100


def test_forest_rows_are_stored_in_even_parts(spark):
    """Rows that come in one partition are spread over all cores before a fit passes over them."""
    got = [r["count"] for r in ml.spread(spark.range(0, 8000, 1, 1)).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(got) == 8000 and len(got) == spark.sparkContext.defaultParallelism and max(got) < 1.2 * min(got)
