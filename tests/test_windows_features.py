from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as ft
from tidemark.operators import legacy, sampling, windows


def brute(w: np.ndarray, variant: str, g_mean: float, g_std: float) -> dict[str, float]:
    """Plain per-window answer."""
    n = len(w)
    h = n // 2

    def fit(y):
        return np.polyfit(np.arange(len(y)), y, 1)

    slope, icpt = fit(w)
    s1, s2 = fit(w[:h])[0], fit(w[h:])[0]
    low, arg, sd = w.min(), int(w.argmin()), w.std()
    z = (low - g_mean) / g_std
    out = {
        "overall_slope": slope, "first_half_slope": s1, "second_half_slope": s2, "trend_consistency": abs(s1 - s2),
        "pressure_drop": w[0] - low, "min_position": arg / (n - 1), "mean": w.mean(), "std": sd, "range": w.max() - low,
        "first_half_mean": w[:h].mean(), "second_half_mean": w[h:].mean(), "mean_ratio": w[h:].mean() / w[:h].mean(),
        "min_zscore": z, "anomaly_strength": abs(low - w.mean()) / sd if sd > 0 else 0.0,
    }
    if variant in "BC":
        out["pressure_drop"] = w.max() - low
    out["drop_rate"] = out["pressure_drop"] / arg if arg else 0.0
    if variant == "B":
        short = [fit(w[i : i + 10])[0] for i in range(n - 10)]
        spread = np.std(short)
        out["trend_consistency"] = 1 / (1 + spread) if spread > 1e-12 else 1.0
        out["drop_rate"] = max(0.0, float((w[:-1] - w[1:]).max()))
        out["anomaly_strength"] = abs(low - (slope * arg + icpt))
    if variant == "D":
        out["min_position"] = arg / n
        out["anomaly_strength"] = abs(z)
    if variant == "C":
        del out["range"]
    return out


SERIES = {
    "noise": lambda r: 745 + r.normal(0, 0.03, 203),
    "ramp": lambda r: 750 - 0.01 * np.arange(203),
    "flat": lambda r: np.full(203, 741.25),
    "two_minima": lambda r: np.where(np.isin(np.arange(203) % 20, (5, 11)), 740.0, 745.0),
    "drift": lambda r: 720 + 0.2 * np.arange(203) + r.normal(0, 0.03, 203),
}


@pytest.mark.parametrize("variant", ft.VARIANTS)
@pytest.mark.parametrize("name", SERIES)
def test_panes_and_long_form_match_brute_force(spark, make_stream, variant, name):
    v = SERIES[name](np.random.default_rng(7))
    s = make_stream(v)
    stats = spark.createDataFrame([(745.0, 8.0)], "g_mean double, g_std double")
    pane = {r["window_id"]: r for r in ft.sliding_features(s, stats, variant, 60, 10, chunk=70).collect()}
    rows = windows.explode_windows(s.select("idx", "pressure"), 60, 10)
    long = {r["window_id"]: r for r in ft.window_features(rows, stats, ["window_id"], variant, 60).collect()}
    assert set(pane) == set(long) == set(range((203 - 60) // 10 + 1))
    for k, r in pane.items():
        want = brute(v[k * 10 : k * 10 + 60], variant, 745.0, 8.0)
        assert (r["start_idx"], r["end_idx"], r["start_sclk"], r["end_sclk"]) == (k * 10, k * 10 + 59, 1000 + k * 10, 1059 + k * 10)
        for f in ft.features_of(variant):
            if name == "flat" and f in ("anomaly_strength", "trend_consistency") and variant == "B":
                assert r[f] == pytest.approx(want[f], abs=1e-6)
                continue
            assert r[f] == pytest.approx(want[f], rel=1e-7, abs=1e-8), (f, k)
            assert long[k][f] == pytest.approx(want[f], rel=1e-7, abs=1e-8), (f, k)


def test_minimum_at_the_ends(spark, make_stream):
    stats = spark.createDataFrame([(0.0, 1.0)], "g_mean double, g_std double")
    up = ft.sliding_features(make_stream(range(60)), stats, "A").head()
    down = ft.sliding_features(make_stream(range(60, 0, -1)), stats, "A").head()
    assert (up["min_position"], up["drop_rate"]) == (0.0, 0.0)
    assert (down["min_position"], down["drop_rate"]) == (1.0, 1.0)


def test_stream_shorter_than_a_window(spark, make_stream):
    s = make_stream(range(59))
    stats = ft.global_stats(s)
    assert ft.sliding_features(s, stats).count() == 0
    assert windows.window_ends(s).count() == 0
    assert windows.explode_windows(s, 60, 10).count() == 0
    assert windows.window_arrays(s, 60, 10).count() == 0


def test_right_edge_labels(make_stream):
    s = make_stream(range(100), det=range(50, 60), fwhm=range(60, 75))
    got = {r["window_id"]: r["l"] for r in windows.window_ends(s, 20, 5).select("window_id", windows.right_edge_label(F.col("gt_detection_win"), F.col("gt_fwhm")).alias("l")).collect()}
    for k, label in got.items():
        end = k * 5 + 19
        assert label == ("True" if 50 <= end < 60 else "Omit" if 60 <= end < 75 else "False")
    kept = windows.numbered_survivors(windows.window_ends(s, 20, 5).withColumn("label", windows.right_edge_label(F.col("gt_detection_win"), F.col("gt_fwhm"))), chunk=16)
    ids = sorted(r["sliding_window_id"] for r in kept.collect())
    assert ids == list(range(sum(x != "Omit" for x in got.values())))


def test_window_arrays_and_padding(spark, make_stream):
    s = make_stream(range(97))
    for size, step in ((60, 10), (60, 50), (20, 7)):
        got = {r["end_idx"]: r["samples"] for r in windows.window_arrays(s, size, step, chunk=30).collect()}
        ends = range(size - 1, 97, step)
        assert got == {e: [float(x) for x in range(e - size + 1, e + 1)] for e in ends}
    row = spark.range(1).select(F.array(F.lit(1.0), F.lit(4.0)).alias("a")).select(windows.pad_last(F.col("a"), 5).alias("b")).head()
    assert row["b"] == [1.0, 4.0, 4.0, 4.0, 4.0]


def test_artefact_rule_on_a_sharp_step(spark):
    flat = [700.0] * 30 + [699.0] * 30
    rise = [700.0 + 0.01 * i for i in range(60)]
    df = spark.createDataFrame([(0, flat), (1, rise)], "k int, samples array<double>")
    out = {r["k"]: r for r in legacy.artefact_features(df).withColumn("bad", legacy.artefact_rule()).collect()}
    assert out[0]["min_slope"] == -1.0 and out[0]["total_drop_after_sharpest"] == -1.0 and out[0]["bad"]
    assert out[0]["avg_slope_after_sharpest"] == pytest.approx(-0.2) and out[0]["consecutive_negative_slopes"] == 0
    # No falling step: the fall after the first one is 0, which is below 0.1.
    assert out[1]["total_drop_after_initial"] == 0.0 and out[1]["bad"]


def test_peaks_with_flat_tops(spark):
    df = spark.createDataFrame([([0.0, 2.0, 2.0, 0.0, 1.0, 0.0, 3.0],)], "samples array<double>")
    r = legacy.shape_features(df).head()
    # The plateau at 2 and nothing else: 1.0 is under the mean and the border 3 never counts.
    assert r["peak_count"] == 1 and r["valley_count"] == 2


def test_sampling_is_layout_free_and_exact(spark, make_stream):
    s = make_stream(range(4000))
    a = sorted(r["idx"] for r in sampling.sample_by_hash(s.repartition(1), "idx", 321).collect())
    b = sorted(r["idx"] for r in sampling.sample_by_hash(s.repartition(9), "idx", 321).collect())
    want = sorted(range(4000), key=lambda i: ((i * 1103515245 + 12345) % 2147483648, i))[:321]
    assert a == b == sorted(want)
    assert sampling.sample_by_hash(s.limit(10), "idx", 50).count() == 10


def test_balance_with_a_dominant_class(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 100 == 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in sampling.balance(df, "k", "y").groupBy("y").count().collect()}
    assert counts == {0: 30, 1: 30}


def test_negatives_touch_no_zone(spark, make_stream):
    det = [*range(400, 412), *range(900, 912)]
    s = make_stream(range(2000), det=det)
    cat = spark.createDataFrame([(0, 1415, 415), (1, 1915, 915)], "vortex long, sclk long, centre long")
    pos = sampling.positive_starts(s, cat, 60, chunk=128)
    assert sorted((r["vortex"], r["start_idx"]) for r in pos.collect()) == [(0, 340), (1, 840)]
    first = sampling.positive_starts(s, cat, 60, mode="first_in_split", chunk=128)
    assert {r["start_idx"] for r in first.collect()} == {340}
    zones = sampling.forbidden_intervals(s, pos, 60, 50, chunk=128)
    bad = np.zeros(2000, bool)
    bad[det] = True
    for st in (340, 840):
        bad[st - 50 : st + 59 + 50] = True
    want = [i for i in range(2000 - 60 + 1) if not bad[i : i + 60].any()]
    assert sorted(r["start_idx"] for r in sampling.free_starts(s, zones, 60).collect()) == want
    assert sampling.training_windows(s, cat, 60, chunk=128).filter("label = 0").count() == 2


def test_precursor_too_close_to_the_start(spark, make_stream):
    s = make_stream(range(300), det=range(30, 40))
    cat = spark.createDataFrame([(0, 1045, 45)], "vortex long, sclk long, centre long")
    assert sampling.positive_starts(s, cat, 60).count() == 0


def test_lost_windows_are_counted_by_reason_in_the_same_pass(spark, make_stream):
    import warnings

    from pyspark.sql import Observation

    from tidemark.operators import sampling

    s = make_stream(range(400), det=[*range(20, 24), *range(150, 155), *range(300, 303)])
    events = spark.createDataFrame([(1, 10), (2, 30), (3, 160), (4, 310), (5, None)], "vortex long, centre long")
    got = {r["vortex"]: (r["start_idx"], r["outcome"]) for r in sampling.positive_outcomes(s, events, 60, chunk=50).collect()}
    assert got == {1: (None, "no_precursor"), 2: (None, "too_short"), 3: (90, "extracted"), 4: (240, "extracted"), 5: (None, "clock_not_found")}
    seen = Observation("outcomes")
    starts = sampling.positive_starts(s, events, 60, chunk=50, outcomes=seen)
    assert sorted(r["start_idx"] for r in starts.collect()) == [90, 240]
    assert seen.get == {"extracted": 2, "clock_not_found": 1, "no_precursor": 1, "too_short": 1}
    first = {r["vortex"]: r["outcome"] for r in sampling.positive_outcomes(s, events, 10, "first_in_split", chunk=50).collect()}
    assert first == {1: "no_precursor", 2: "extracted", 3: "extracted", 4: "extracted", 5: "clock_not_found"}

    free = spark.range(7).withColumnRenamed("id", "start_idx")
    drawn = Observation("drawn")
    assert sampling.negative_starts(free, starts, 5.0, drawn).count() == 7
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert sampling.shortfall(drawn) == 3 and len(said) == 1
    assert sampling.negative_report(free, starts, 3.0).first().asDict() == {"wanted": 6, "available": 7, "drawn": 6, "shortfall": 0}


def test_pane_aggregates_equal_those_of_copied_samples(spark):
    """Any size and step, nulls included, against windows that copy their samples; no copies in the plan."""
    import random

    from tidemark.operators import panes, windows

    r = random.Random(7)
    rows = [(i, None if r.random() < 0.2 else round(r.gauss(700, 2), 3), None if 40 <= i < 90 else r.random() < 0.05) for i in range(257)]
    s = spark.createDataFrame(rows, "idx long, v double, flag boolean").repartition(3)
    v, i = F.col("v"), F.col("idx")
    wanted = {
        "rows": panes.count(), "n": panes.count(v), "total": panes.total(v), "low": panes.low(v), "high": panes.high(v), "any": panes.high(F.col("flag")),
        "first": panes.first(v), "last": panes.last(v), "at": panes.place_of_low(v), "mean": panes.mean(v), "std": panes.sample_std(v),
    }
    for size, step in ((60, 10), (21, 3), (10, 10), (7, 2), (8, 12), (300, 10)):
        out = panes.window_summary(s, size, step, wanted, chunk=32)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # Only rows at the chunks' borders are copied, and these are panes: the one Generate stands above the aggregate.
        assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate") and "Join" not in plan
        got = {x["window_id"]: x for x in out.collect()}
        long = windows.explode_windows(s, size, step)
        want = long.groupBy("window_id").agg(
            F.count(F.lit(1)).alias("rows"), F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.bool_or("flag").alias("any"),
            F.min_by(v, i).alias("first"), F.max_by(v, i).alias("last"), F.min(F.when(v.isNotNull(), F.struct(v, i)))["idx"].alias("at"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        ).collect()
        assert len(got) == len(want) == max(0, (257 - size) // step + 1)
        for x in want:
            g = got[x["window_id"]]
            assert (g["start_idx"], g["end_idx"]) == (x["window_id"] * step, x["window_id"] * step + size - 1)
            for k in wanted:
                assert g[k] == (x[k] if x[k] is None or not isinstance(x[k], float) else pytest.approx(x[k], rel=1e-9)), (size, step, k)


@pytest.mark.parametrize("every", [1, 7])
def test_mean_patterns_equal_copied_neighbourhoods(spark, every):
    """Anchors on every row, or some; nulls and the stream's ends; chunks shorter than the frame."""
    from tidemark.operators import aggregates

    rows = [(i, None if i % 11 == 3 else 700 + (i * 37 % 23) / 3) for i in range(130)]
    s = spark.createDataFrame(rows, "idx long, pressure double").repartition(3)
    kind = F.when(F.col("idx") % every == 0, F.when(F.col("idx") % 2 == 0, "a").otherwise("b"))
    got = {(r["kind"], r["rel_pos"]): r for r in aggregates.mean_patterns(s, kind, 6, chunk=20).collect()}
    v = dict(rows)
    for k in ("a", "b"):
        anchors = [i for i in range(0, 130, every) if (i % 2 == 0) == (k == "a")]
        for r in range(-6, 7):
            there = [i + r for i in anchors if 0 <= i + r < 130]
            x = [v[i] for i in there if v[i] is not None]
            d = [v[i] - v[i - 1] for i in there if i and v[i] is not None and v[i - 1] is not None]
            g = got.pop((k, r))
            assert g["n"] == len(there) and g["mean_p"] == pytest.approx(np.mean(x)) and g["std_p"] == pytest.approx(np.std(x)) and g["mean_step"] == pytest.approx(np.mean(d))
    assert not got


@pytest.mark.parametrize("wanted", [3, 40, 10_000])
def test_drawing_under_a_bound_equals_drawing_from_all_free_starts(spark, make_stream, wanted):
    """Few, many and more than there are; most starts are blocked, so that the bound must rise."""
    s = make_stream([0.0] * 30_000)
    zones = spark.createDataFrame([(0, 29_500)], "lo long, hi long")
    got = sorted(r["start_idx"] for r in sampling.drawn_starts(s, zones, wanted, 60).collect())
    whole = sampling.sample_by_hash(sampling.free_starts(s, zones, 60), "start_idx", wanted)
    assert got == sorted(r["start_idx"] for r in whole.collect()) and len(got) == min(wanted, 440)
