"""Benchmark: wall seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

``BENCH_QUERIES`` (comma-separated prefixes) narrows the run. ``x2_index_build`` is the ingestion
step, timed on its own; queries after it read the stored stream, as they would in use.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans import base
from tidemark.plans.catalog import load
from tidemark.session import local_session

HEADLINE = [
    "w1_f_sliding_features_a", "f01_f15_variant_b", "f01_f15_variant_c", "f01_f15_variant_d", "f17_hit_features",
    "f18_detrended_features", "f19_shape_features", "f21_c3_expanding_stats", "f24_rate_of_change", "f25_savitzky_golay",
    "f26_f27_f28_sequence_features", "f29_moving_average_500", "w3_any_in_window", "w10_f22_f23_artefacts",
    "x3_split_70", "j5_interval_flags", "j7_interval_overlap", "j11_asof_precursor", "j12_c1_score_alignment",
    "j13_free_window_starts", "n2_training_features_a", "g1_contiguous_regions", "g2_nested_events", "g9_latch_on",
    "t4_roc_auc", "t5_average_precision", "t6_sweep_99", "t8_f1_optimal", "t18_event_level", "t19_event_overlap",
    "t20_triggered_pointwise", "a8_correlation_matrix", "a9_percentiles", "a17_mean_patterns", "q3_row_quality",
    "q11_stats_consistency", "m1_random_forest", "m9_reconstruction_gate", "s13_page_links", "r2_live_sliding_features",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before timing

    times: dict[str, float] = {}
    t0 = time.perf_counter()
    base.stream(spark, sf)
    base.chunk(spark, sf)
    times["x2_index_build"] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        t0 = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    windows = base.wends(spark, sf).count()
    feature_s = times.get("w1_f_sliding_features_a")
    print(
        json.dumps(
            {
                "metric": "total_wall_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": cpus,
                "windows": windows,
                "ms_per_window_features": round(feature_s / windows * 1000, 4) if feature_s else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
