"""Staged boosting and the grid: prefixes, stopping rule, exact curves, rungs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting
from tidemark.operators import metrics as m
from tidemark.operators.boosting import best_prefix, fit_staged, fit_trees, prefix_precision, search, settings, weighted
from tidemark.operators.ml import assembler

FEATURES = ["a", "b", "c"]
SETTING = {"depth": 3, "rate": 0.2, "sample": 0.8, "columns": 0.8, "leaf": 2, "gain": 0.0}


@pytest.fixture(scope="module")
def parts(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.7 * r.normal(size=600) > 1).astype(int)
    df = spark.createDataFrame([(i, *map(float, row), int(v)) for i, (row, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    return df.filter("id < 400").cache(), df.filter("id >= 400").cache()


def test_stopping_rule():
    assert best_prefix([0.1, 0.3, 0.2, 0.2], 2) == (2, True)
    assert best_prefix([0.1, 0.3, 0.2, 0.4], 3) == (4, False)
    assert best_prefix([0.1, 0.3, 0.2, 0.2, 0.9], 2) == (2, True)  # what comes after the stop is not seen
    assert best_prefix([0.2, 0.2, 0.2], 5) == (1, False)


def test_longer_fits_begin_with_the_trees_of_shorter_ones(parts):
    rows = assembler(FEATURES).transform(weighted(parts[0], FEATURES))
    long, short = (fit_trees(rows, FEATURES, n, **SETTING) for n in (6, 3))
    assert long.weights[:3] == short.weights
    for a, b in zip(long.nodes[:3], short.nodes):
        assert all((x == y).all() for x, y in zip(a, b))


def test_exported_trees_score_as_the_model_does(parts):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    rows = assembler(FEATURES).transform(weighted(parts[0], FEATURES))
    model = GBTClassifier(labelCol="y", featuresCol="features", weightCol="weight", maxIter=5, maxDepth=4, seed=1).fit(rows)
    trees = boosting.Trees.of(model.toDebugString, FEATURES, 4)
    want = {r["id"]: r["p"] for r in model.transform(assembler(FEATURES).transform(parts[1])).select("id", vector_to_array("probability")[1].alias("p")).collect()}
    got = {r["id"]: r["p"] for r in trees.score(parts[1]).collect()}
    assert got == pytest.approx(want)


def test_kept_prefix_is_the_best_by_exact_curves(parts):
    fit = fit_staged(*parts, FEATURES, rounds=24, patience=6, block=4, **SETTING)
    best, _ = best_prefix(fit.curve, 6)
    assert fit.best == best and fit.curve[best - 1] == max(fit.curve[: best + 6])
    assert len(fit.curve) >= min(24, best + 6)
    ap = m.average_precision(m.score_curve(fit.trees.score(parts[1]))).first()[0]
    assert ap == pytest.approx(fit.curve[best - 1])
    again = prefix_precision(fit.trees, parts[1], after=best - 1)
    assert again == pytest.approx([ap]) and ap > 0.5


def test_validation_without_positives_keeps_the_first_tree(parts):
    fit = fit_staged(parts[0], parts[1].filter("y = 0"), FEATURES, rounds=4, patience=2, block=4, **SETTING)
    assert fit.best == 1 and set(fit.curve) == {0.0}


def test_search_reports_what_it_dropped(parts):
    assert len(settings()) == 144
    grid = settings({"depth": [1, 3], "rate": [0.05, 0.3]})
    best, results = search(*parts, FEATURES, grid, rungs=(1, 4), keep=0.5, parallel=3)
    rows = results.collect()
    assert sorted((r["rounds"], r["dropped"]) for r in rows) == [(1, True), (1, True), (4, False), (4, False)]
    f1 = m.with_rates(m.confusion(best.score(parts[1]), F.col("p") >= 0.5)).first()["f1"]
    assert f1 == max(r["f1"] for r in rows if not r["dropped"])
    _, every = search(*parts, FEATURES, grid, rungs=(2,), parallel=1)
    assert not every.filter("dropped").count() and every.count() == 4


def test_a_fit_goes_on_from_its_trees(parts, monkeypatch):
    rows = boosting.Binned.of(weighted(parts[0], FEATURES), FEATURES)
    whole, begun = (fit_trees(rows, FEATURES, n, **SETTING) for n in (5, 3))
    grown, grow = [], boosting._grow
    monkeypatch.setattr(boosting, "_grow", lambda states, binned, number, *a: grown.append(number) or grow(states, binned, number, *a))
    monkeypatch.setattr(boosting, "CHAIN", 1)
    further = fit_trees(rows, FEATURES, 5, **SETTING, begun=begun)
    assert grown == [3, 4] and len(begun.nodes) == 3 and further.weights == whole.weights
    for a, b in zip(further.nodes, whole.nodes):
        assert all(x == pytest.approx(y) for x, y in zip(a, b))


def test_trees_are_those_of_the_library(parts):
    """All rows, all features and few distinct values leave nothing to draw: the same trees, hence the same scores."""
    from pyspark.ml.classification import GBTClassifier

    few = [df.select("id", *[F.round(F.least(F.greatest(F.col(f), F.lit(-1.5)), F.lit(1.5)) * 4).alias(f) for f in FEATURES], "y") for df in parts]
    rows = assembler(FEATURES).transform(weighted(few[0], FEATURES))
    model = GBTClassifier(labelCol="y", featuresCol="features", weightCol="weight", maxIter=5, maxDepth=3, stepSize=0.2, minInstancesPerNode=2, seed=1).fit(rows)
    theirs = boosting.Trees.of(model.toDebugString, FEATURES, 3)
    mine = fit_trees(rows, FEATURES, 5, **{**SETTING, "sample": 1.0, "columns": 1.0})
    assert mine.weights == theirs.weights
    a, b = (np.array([r["p"] for r in t.score(few[1].orderBy("id")).collect()]) for t in (mine, theirs))
    assert a == pytest.approx(b, abs=1e-6)


def test_curves_are_exact_over_many_ranges(spark, monkeypatch):
    """Ties across batches and ranges, and missing values, rated as one sorted list would be."""
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=300), 1)
    x[::50] = np.nan
    y = (r.random(300) < 0.2).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "a double, y int").repartition(3)
    node = lambda t, low, high: (np.zeros(3, int), np.array([t, 0.0, 0.0]), np.array([1, 1, 2]), np.array([2, 1, 2]), np.array([0.0, low, high]))
    trees = boosting.Trees(["a"], [node(t, -1.0, 0.5) for t in (-0.8, -0.3, 0.1, 0.6, 1.1)], [1.0, 0.3, 0.3, 0.3, 0.3], 1)
    monkeypatch.setattr(boosting, "ROWS", 40)
    margins = trees.margins(x[:, None])
    for after in (0, 2):
        want = []
        for k in range(after, 5):
            m_ = margins[:, k]
            want.append(sum(((m_ >= v) & (y == 1)).sum() / (m_ >= v).sum() for v in m_[y == 1]) / y.sum())
        assert prefix_precision(trees, df, after) == pytest.approx(want)
