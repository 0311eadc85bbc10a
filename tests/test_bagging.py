"""The forest of two classes: splits by brute force, counts that add up, groups that change nothing, and the library's forest beside it."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import bagging, metrics, ml
from tidemark.operators.forests import ForestModel
from tidemark.session import materialise

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(3000, 4)), 2)
    y = (x[:, 0] + np.abs(x[:, 1]) + 0.7 * r.normal(size=3000) > 1.5).astype(int)
    rows = [(i, *map(float, row), int(c)) for i, (row, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "window_id long, a double, b double, c double, d double, y int").repartition(5).cache()


def fit(data, **kw):
    return ml.fit_forest(data, FEATURES, **{"trees": 8, "depth": 6, "leaf": 5, **kw})


def auc(model, df):
    return metrics.roc_auc(metrics.score_curve(ml.score(model, df))).first()["roc_auc"]


def words(model):
    return [(t.word.tolist(), t.share.tolist()) for t in model.forest.trees]


def test_splits_are_those_of_brute_force():
    r = np.random.default_rng(1)
    counts, share, leaf = r.integers(0, 6, (5, 2, bagging.BINS, 2)), np.array([0.6, 4.0]), 7
    counts[3, 0, :, 1] = 0  # nothing to part
    counts[:, 1] = counts[:, 0, r.permutation(bagging.BINS)]  # the same rows by another feature
    ok, slot, cut, gain, whole, left = bagging._pick(share, leaf)(counts)

    def gini(c):
        w = c * share
        return 1 - ((w / w.sum()) ** 2).sum() if w.sum() else 0.0

    for i, node in enumerate(counts):
        best = -np.inf
        for k in range(2):
            for b in range(bagging.BINS):
                a, z = node[k, : b + 1].sum(axis=0), node[k, b + 1 :].sum(axis=0)
                if min(a.sum(), z.sum()) < leaf:
                    continue
                n = ((a + z) * share).sum()
                best = max(best, gini(a + z) - (a * share).sum() / n * gini(a) - (z * share).sum() / n * gini(z))
        assert (gain[i] == pytest.approx(best, abs=1e-12)) and ok[i] == (best > 1e-15)
        assert (left[i] == counts[i, slot[i], : cut[i] + 1].sum(axis=0)).all() and (whole[i] == counts[i, 0].sum(axis=0)).all()
    assert not ok[3]


def test_two_classes_are_grown_a_level_a_job_as_well_as_by_the_library(spark, data):
    data.count()
    jobs = []
    for depth in (3, 6):
        spark.sparkContext.setJobGroup(f"bagging-{depth}", "")
        model = fit(data, depth=depth)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"bagging-{depth}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert isinstance(model.stages[-1], ForestModel) and jobs[1] - jobs[0] == 3
    library = ml.forest(FEATURES, trees=8, depth=6).fit(ml.balanced_weights(data))
    assert auc(model, data) == pytest.approx(auc(library, data), abs=0.03)
    ours, theirs = (m.stages[-1].featureImportances.toArray() for m in (model, library))
    assert ours.sum() == pytest.approx(1) and np.abs(ours - theirs).max() < 0.12 and set(ours.argsort()[2:]) == set(theirs.argsort()[2:]) == {0, 1}


def test_groups_of_trees_and_slices_of_nodes_change_nothing(data, monkeypatch):
    rows = materialise(data.select(*FEATURES, "y", F.lit(1.0).alias("weight")).coalesce(1))  # one file: draws go by place
    grow = lambda: words(bagging.fit(rows, FEATURES, {0: 1.0, 1: 3.0}, trees=8, depth=6))
    whole = grow()
    monkeypatch.setattr(bagging, "NODES", 3)
    monkeypatch.setattr(bagging, "SLICE", 2)
    assert grow() == whole


def test_leaves_hold_enough_draws_and_a_node_s_rows_are_its_children_s(data, monkeypatch):
    grown, finish = [], bagging._Tree.finish
    monkeypatch.setattr(bagging._Tree, "finish", lambda t, *a: grown.append((t.left.copy(), t.counts.copy())) or finish(t, *a))
    fit(data, leaf=9)
    for left, counts in grown:
        at = np.flatnonzero(left >= 0)
        assert len(at) > 3 and (counts[at] == counts[left[at]] + counts[left[at] + 1]).all() and counts.sum(axis=1).min() >= 9
        assert abs(counts[0].sum() - 3000) < 400  # each tree has its own draws
    assert len({tuple(c[0]) for _, c in grown}) > 1


def test_rows_without_a_value_are_refused_as_the_library_does(data):
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="NaN"):
            fit(data.withColumn("b", F.when(F.col("window_id") != 7, F.col("b")).otherwise(F.lit(bad).cast("double"))))


def test_probabilities_add_up_and_missing_values_go_right(spark, data):
    model = fit(data)
    got = spark.createDataFrame([(i, [float("nan")] * 4) for i in range(3)] + [(3, [99.0] * 4)], "i long, x array<double>")
    rows = model.stages[-1].transform(got.select("i", array_to_vector("x").alias("features"))).orderBy("i").collect()
    assert all(r["probability"].toArray().sum() == pytest.approx(1) and r["prediction"] == r["probability"].argmax() for r in rows)
    assert len({r["probability"] for r in rows}) == 1
    assert ml.score(model, data.filter("false")).count() == 0 and ml.score(model, data).filter(F.col("p").between(0, 1)).count() == 3000


def test_other_labels_keep_the_library(data):
    many = data.withColumn("y", F.col("y") + (F.col("window_id") % 2).cast("int"))
    assert not isinstance(fit(many, trees=2, depth=2).stages[-1], ForestModel)
    constant = ml.fit_forest(data.withColumn("a", F.lit(1.0)), ["a"], trees=2, depth=3)
    assert constant.stages[-1].featureImportances.toArray().tolist() == [0.0]
    assert ml.score(constant, data.withColumn("a", F.lit(2.0))).select("p").distinct().count() == 1
