from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import prior_corrected
from tidemark.operators import aggregates as ag
from tidemark.operators import metrics as m
from tidemark.operators import thresholds as th


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(11)
    rows = [(i, i, round(min(1.0, max(0.0, rng.gauss(0.6 if i % 9 == 0 else 0.4, 0.2))), 2), int(i % 9 == 0)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "window_id long, end_idx long, p double, y int").repartition(5)


def brute(rows, t):
    tp = sum(p >= t and y == 1 for *_, p, y in rows)
    fp = sum(p >= t and y == 0 for *_, p, y in rows)
    return tp, fp, sum(y == 0 for *_, y in rows) - fp, sum(y == 1 for *_, y in rows) - tp


@pytest.mark.parametrize("grid", [m.linspace(0.01, 0.99, 99), [i * 0.05 for i in range(1, 20)], [0.1, 0.45, 0.9], [0.5]])
def test_sweep_equals_one_pass_per_threshold(scores, grid):
    rows, df = scores
    got = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in m.sweep(df, grid).collect()}
    assert got == {t: brute(rows, t) for t in grid}


def test_curves(scores):
    rows, df = scores
    pos, neg = [p for *_, p, y in rows if y], [p for *_, p, y in rows if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    c = m.score_curve(df)
    assert m.roc_auc(c).head()[0] == pytest.approx(auc, abs=1e-12)
    ap, last = 0.0, 0.0
    for t in sorted({p for *_, p, _ in rows}, reverse=True):
        tp, fp, _, _ = brute(rows, t)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    assert m.average_precision(c).head()[0] == pytest.approx(ap, abs=1e-12)


def test_one_class_only_and_equal_scores(spark):
    same = spark.createDataFrame([(i, 0.5, i % 2) for i in range(10)], "window_id long, p double, y int")
    assert m.roc_auc(m.score_curve(same)).head()[0] == 0.5
    ones = same.withColumn("y", F.lit(1))
    assert m.roc_auc(m.score_curve(ones)).head()[0] == 0.0
    r = m.with_rates(m.confusion(ones, F.col("p") >= 0.9)).head()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["precision"], r["f1"]) == (0, 0, 0, 10, 0.0, 0.0)


def test_published_arithmetic(spark):
    """Identities of the published threshold tables: 495 false alarms and 217 misses in 53,582 windows."""
    assert 495 / 53582 * th.PER_HOUR == pytest.approx(5.5429, abs=1e-4)
    fp = 27.00907 / th.PER_HOUR * 53582
    row = spark.createDataFrame([(0.636, 0.0, fp, 53582 - 217 - fp, 217.0)], "threshold double, tp double, fp double, tn double, fn double")
    assert th.mission_cost(row).head()["cost"] == pytest.approx(2818.2177, abs=1e-3)


def test_high_precision_relaxes_when_out_of_reach(spark):
    pr = spark.createDataFrame([(0.2, 0.3, 1.0), (0.5, 0.5, 0.6), (0.8, 0.49, 0.2)], "threshold double, precision double, recall double")
    assert th.high_precision(pr, 0.9).head()["threshold"] == 0.5
    assert th.high_precision(pr, 0.3).head()["threshold"] == 0.2
    assert th.high_recall(pr, 0.9).head()["threshold"] == 0.2
    assert th.high_precision(pr, 0.9, compat=True).head()["threshold"] == 0.5


def test_ties_take_the_first_maximum(spark):
    rates = spark.createDataFrame([(0.1, 0.5), (0.2, 0.5), (0.3, 0.4)], "threshold double, f1 double")
    assert m.best(rates, F.col("f1"), F.col("threshold")).head()["threshold"] == 0.1


def test_vote_needs_k_of_n_and_shortens_at_the_start(spark):
    p = [0.9, 0.1, 0.9, 0.9, 0.1, 0.1, 0.9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "window_id long, p double")
    got = [r["vote"] for r in m.trailing_vote(df, 0.5, chunk=2).orderBy("window_id").collect()]
    assert got == [0, 0, 1, 1, 1, 0, 0]


def test_prior_correction_is_identity_for_equal_priors(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (1.0,)], "p double")
    got = [r[0] for r in df.select(prior_corrected(F.col("p"), 0.2, 0.2)).collect()]
    assert got == pytest.approx([0.0, 0.3, 1.0], abs=1e-9)


def test_student_p_values():
    """Tabulated two-sided points: t(10) = 2.228 at 5 %, t(30) = 2.750 at 1 %, t(1) = 12.706 at 5 %."""
    got = ag.student_p(pd.Series([2.228, 2.750, 12.706, 0.0]), pd.Series([10, 30, 1, 5]))
    assert got.tolist() == pytest.approx([0.05, 0.01, 0.05, 1.0], abs=2e-4)


def test_constant_feature_has_no_correlation(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(-i)) for i in range(20)], "a double, b double, c double")
    got = {(r["f1"], r["f2"]): r["r"] for r in ag.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] == pytest.approx(-1.0) and got[("a", "b")] is None


def test_a_hundred_thousand_thresholds_by_rank_merge(spark):
    """Counts at every threshold, equals on both sides, nulls and NaN; other columns of the table stay."""
    import numpy as np

    from tidemark.operators import metrics

    r = np.random.default_rng(5)
    p = np.round(r.random(5000), 3)
    y = (r.random(5000) < p).astype(int)
    rows = [(float(a), int(b)) for a, b in zip(p, y)] + [(None, 1), (None, 0), (float("nan"), 1)]
    df = spark.createDataFrame(rows, "p double, y int")
    ts = spark.range(100_000).select(F.col("id"), (F.col("id") / 50_000 - 0.5).alias("threshold"))
    for strict in (False, True):
        got = metrics.sweep_table(df, ts, strict=strict).orderBy("id").toPandas()
        assert list(got.columns) == ["id", "threshold", "tp", "fp", "tn", "fn"] and len(got) == 100_000
        t = got["threshold"].to_numpy()
        for name, hits, extra in (("tp", np.sort(p[y == 1]), 1), ("fp", np.sort(p[y == 0]), 0)):
            reached = len(hits) - np.searchsorted(hits, t, side="right" if strict else "left")
            assert (got[name] == reached + extra).all()  # NaN reaches all
        assert ((got["tp"] + got["fn"]) == (y == 1).sum() + 2).all() and ((got["fp"] + got["tn"]) == (y == 0).sum() + 1).all()
    none = metrics.sweep_table(df.limit(0), ts.limit(2)).collect()
    assert [(r["tp"], r["fp"], r["tn"], r["fn"]) for r in none] == [(0, 0, 0, 0)] * 2
