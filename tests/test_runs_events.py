from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, intervals, runs
from tidemark.operators import event_metrics as em


def brute_runs(flags):
    out, start = [], None
    for i, f in enumerate(flags):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start, i - 1))
            start = None
    return out + ([(start, len(flags) - 1)] if start is not None else [])


@pytest.mark.parametrize("chunk", [4, 16, 1000])
def test_runs_longer_than_a_chunk_and_open_at_the_end(spark, make_stream, chunk):
    rng = random.Random(2)
    flags = [rng.random() < 0.6 for _ in range(120)]
    flags[30:75] = [True] * 45
    flags[110:] = [True] * 10
    s = make_stream(range(120), det=[i for i, f in enumerate(flags) if f])
    got = sorted((r["start_idx"], r["end_idx"]) for r in runs.runs(s, F.col("gt_detection_win"), chunk).collect())
    assert got == brute_runs(flags)
    rows = runs.run_rows(s, F.col("gt_detection_win"), chunk).collect()
    where = {i: a for a, b in got for i in range(a, b + 1)}
    assert {r["idx"]: r["run_start"] for r in rows} == where


def test_clock_runs(make_stream):
    s = make_stream(range(20), det=[2, 3, 18, 19])
    got = sorted((r["start_sclk"], r["end_sclk"]) for r in runs.clock_runs(s, F.col("gt_detection_win"), 8).collect())
    assert got == [(1002, 1003), (1018, 1019)]


def brute_nested(p, det, fwhm, wide):
    """Scan for events, one wide run at a time; the last open run is kept."""
    out = []
    for a, b in brute_runs(wide):
        core = [j for j in range(a, b + 1) if fwhm[j]]
        if not core:
            continue
        f0, f1 = core[0], core[-1]
        d1 = next((j for j in range(f0 - 1, max(a, f0 - 200), -1) if det[j]), None)
        d0 = None
        if d1 is not None:
            for j in range(d1, max(a, d1 - 200), -1):
                if not det[j]:
                    break
                d0 = j
        peak = min((p[j], j) for j in core)[1]
        out.append((peak, d0, d1, f0, f1, a, b))
    return sorted(out)


def test_nested_events_match_a_row_scan(make_stream):
    rng = random.Random(4)
    n = 900
    p = [rng.choice([1.0, 2.0, 3.0]) for _ in range(n)]
    det, fwhm, wide = [False] * n, [False] * n, [False] * n
    for c in (60, 300, 320, 700, 893):
        for j in range(max(0, c - 25), min(n, c + 15)):
            wide[j] = True
        for j in range(c - 2, min(n, c + 3)):
            fwhm[j] = True
        for j in range(c - 30, c - 4):
            det[j] = True
    wide[500:520] = [True] * 20  # a wide run without an event
    ids = lambda f: [i for i, x in enumerate(f) if x]
    s = make_stream(p, ids(det), ids(fwhm), ids(wide))
    cols = ["peak_idx", "detection_start", "detection_end", "fwhm_start", "fwhm_end", "fourxfwhm_start", "fourxfwhm_end"]
    got = sorted(tuple(r[c] for c in cols) for r in runs.nested_events(s, 64).collect())
    want = []
    for row in brute_nested(p, det, fwhm, wide):
        want.append(row)
    # Several event cores in one wide run: the peak is the first lowest among flagged rows.
    assert got == want


def test_interval_join_and_overlap_join(spark):
    rng = random.Random(6)
    pts = [(i,) for i in rng.sample(range(3000), 300)]
    iv = [(k, a, a + rng.randrange(0, 700)) for k, a in enumerate(rng.choices(range(2500), k=60))]
    points = spark.createDataFrame(pts, "x long")
    spans = spark.createDataFrame(iv, "k long, lo long, hi long")
    got = sorted((r["x"], r["k"]) for r in intervals.interval_join(points, spans, "x", "lo", "hi", width=64).collect())
    assert got == sorted((x, k) for (x,) in pts for k, a, b in iv if a <= x <= b)
    other = spans.select(F.col("k").alias("j"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    pairs = sorted((r["k"], r["j"]) for r in intervals.overlap_join(spans, other, "lo", "hi", "l2", "h2", width=64).collect())
    assert pairs == sorted((k, j) for k, a, b in iv for j, c, d in iv if b >= c and a <= d)


def test_flags_of_close_events_merge(spark, make_stream):
    s = make_stream(range(60)).select("idx", "sclk")
    cat = spark.createDataFrame([(20,), (22,)], "centre long")
    got = {r["idx"] for r in intervals.flag_around(s, cat, {"f": (-2, 2)}).filter("f").collect()}
    assert got == set(range(18, 25))


def test_lookup_takes_the_first_of_repeated_clocks(spark):
    s = spark.createDataFrame([(0, 5), (1, 7), (2, 7)], "idx long, sclk long")
    e = spark.createDataFrame([(1, 7), (2, 9)], "vortex long, sclk long")
    got = {r["vortex"]: r["idx"] for r in intervals.lookup_by_clock(e, s).collect()}
    assert got == {1: 1, 2: None}


def test_score_alignment_before_the_first_score(spark, make_stream):
    s = make_stream(range(30)).select("idx")
    sc = spark.createDataFrame([(9, 0.4), (19, 0.7)], "end_idx long, p double")
    got = {r["idx"]: r["score"] for r in asof.align_scores(s, sc, chunk=8).collect()}
    assert [got[0], got[8], got[9], got[18], got[19], got[29]] == [0.0, 0.0, 0.4, 0.4, 0.7, 0.7]
    raw = {r["idx"]: r["score"] for r in asof.align_scores(s, sc, fill=None, chunk=8).collect()}
    assert raw[3] is None and raw[12] == 0.4


def brute_latch(det, fwhm, hit):
    tp = fp = fn = tn = 0
    i, n = 0, len(hit)
    while i < n:
        if det[i] or fwhm[i]:
            if det[i] and hit[i]:
                while i < n and (det[i] or fwhm[i]):
                    tp, i = tp + 1, i + 1
                continue
            fn += 1
        elif hit[i]:
            fp += 1
        else:
            tn += 1
        i += 1
    return tp, fp, fn, tn


def test_latch_scoring_matches_a_row_scan(make_stream):
    rng = random.Random(8)
    n = 400
    det = [i % 80 in range(20, 30) for i in range(n)]
    fwhm = [i % 80 in range(30, 36) for i in range(n)]
    p = [rng.random() for _ in range(n)]
    s = make_stream(range(n), [i for i in range(n) if det[i]], [i for i in range(n) if fwhm[i]], p=p)
    r = em.latch_on(s, F.col("p") >= 0.85, chunk=32).head()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == brute_latch(det, fwhm, [x >= 0.85 for x in p])


def test_no_events_and_no_hits(make_stream):
    s = make_stream(range(50))
    r = em.latch_on(s, F.col("p") >= 0.5).head()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (0, 0, 0, 50, 0.0)
    e = em.event_counts(s, s.filter("p > 1").select("idx")).head()
    assert (e["tp"], e["fp"], e["fn"]) == (0, 0, 0)
    assert em.lead_times(s, F.col("p") >= 0.5).head()["events"] == 0
