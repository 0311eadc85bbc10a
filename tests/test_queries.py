"""Every registered query against its SQL, and rules that all plans keep."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canon
from tests.conftest import SF_TINY

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# A spread over all families; CHECK_ALL=1 compares every query.
SOME = [
    "w1_f_sliding_features_a", "f01_f15_variant_b", "x2_dense_index", "x3_split_60", "j7_interval_overlap", "j12_c1_score_alignment",
    "g1_contiguous_regions", "g2_nested_events", "n2_combined_windows", "f18_detrended_features", "t6_sweep_99", "t8_f1_optimal",
    "t20_triggered_pointwise", "a9_percentiles", "q3_row_quality", "u4_u3_compare_datasets", "s13_page_links", "m10_keep_top_per_class",
    "r2_live_sliding_features",
]
NAMES = sorted(ORACLES) if os.environ.get("CHECK_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_TINY}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, SF_TINY).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 150


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) == 19


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Row-position operators: their exchanges are by chunk, pane or key, never one partition.
SPREAD = [
    "w1_f_sliding_features_a", "f01_f15_variant_b", "f18_detrended_features", "f19_shape_features", "f24_rate_of_change",
    "f25_savitzky_golay", "f26_f27_f28_sequence_features", "f29_moving_average_500", "w3_any_in_window", "w4_next_sample_label",
    "j5_interval_flags", "j6_points_in_events", "j8_containment", "w11_context_windows", "g5_vote", "k1_top_per_outcome",
]


@pytest.mark.parametrize("name", SPREAD)
def test_no_single_task_and_no_nested_loops(spark, name):
    text = plan(QUERIES[name](spark, SF_TINY))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "EvalPython" not in text
    # A window without partitioning may only run over chunk summaries, never over stream columns.
    for window in re.findall(r"Window \[[^\n]*", text):
        if "windowspecdefinition(_chunk" in window or "partition" in window:
            continue
        assert "pressure" not in window


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["x5_clock_range"](spark, SF_TINY))
    assert "PushedFilters: [IsNotNull(sclk), GreaterThanOrEqual(sclk" in text
    scan = plan(QUERIES["s2_projected_scan"](spark, SF_TINY))
    assert re.search(r"ReadSchema: struct<event_id:bigint,value:double>", scan)
