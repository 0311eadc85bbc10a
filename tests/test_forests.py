"""A forest read as arrays: the fitted model's own predictions, and as many walks as replaced values ask for."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import forests, ml

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def fitted(spark):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(400, 3)), 1)
    y = (x[:, 0] + np.abs(x[:, 1]) + 0.5 * r.normal(size=400) > 1).astype(int)
    df = spark.createDataFrame([(i, *map(float, row), int(v)) for i, (row, v) in enumerate(zip(x, y))], "window_id long, a double, b double, c double, y int").cache()
    return df, x, ml.fit_forest(df, FEATURES, trees=7, depth=6, leaf=2)


def predictions(spark, model, rows):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(rows)], "i long, x array<double>")
    got = model.stages[-1].transform(df.select("i", array_to_vector("x").alias("features"))).select("i", "prediction").collect()
    return np.array([r["prediction"] for r in sorted(got)])


def test_predictions_with_replaced_features_are_the_models_own(spark, fitted):
    _, x, model = fitted
    x = x.copy()
    x[::20, 2] = np.nan  # a missing value goes right, as in the model
    donors = np.stack([x[::-1], np.roll(x, 5, axis=0)])
    base, tried = forests.Forest.of(model.stages[-1], FEATURES, spark).replaced(x, donors)
    assert (base == predictions(spark, model, x)).all()
    mixed = np.broadcast_to(x[None, :, None, :], (2, 400, 3, 3)).copy()
    for j in range(3):
        mixed[:, :, j, j] = donors[:, :, j]
    assert (tried.ravel() == predictions(spark, model, mixed.reshape(-1, 3))).all()


def test_a_value_that_stays_in_its_leaf_walks_no_tree_again(spark, fitted, monkeypatch):
    _, x, model = fitted
    walked, leaves = [], forests.Tree.leaves
    monkeypatch.setattr(forests.Tree, "leaves", lambda t, places, width, rows: walked.append(len(rows)) or leaves(t, places, width, rows))
    forest = forests.Forest.of(model.stages[-1], FEATURES, spark)
    forest.replaced(x, x[None])
    assert sum(walked) == 400 * 7  # the rows' own paths alone
    walked.clear()
    forest.replaced(x, x[::-1][None])
    assert 400 * 7 < sum(walked) < 400 * 7 * 4


def test_importance_is_that_of_scoring_every_copy(spark, fitted):
    df, x, model = fitted
    labelled = df.withColumn("y", F.when(F.col("window_id") % 50 != 0, F.col("y")))  # rows without a label do not count
    got = {r["feature"]: (r["mean_drop"], r["std_drop"]) for r in ml.permutation_importance(model, labelled, FEATURES, repeats=2).collect()}
    y = np.array([np.nan if r["y"] is None else r["y"] for r in labelled.orderBy("window_id").collect()])
    known, base, falls = ~np.isnan(y), predictions(spark, model, x), {f: [] for f in FEATURES}
    for r, a in enumerate((247, 249)):  # the first numbers from 0.618 n + r on that share no factor with 400
        donor = np.empty_like(x)
        donor[(np.arange(400) * a + 7919 * (r + 1)) % 400] = x
        for j, f in enumerate(FEATURES):
            mixed = x.copy()
            mixed[:, j] = donor[:, j]
            falls[f].append(((base == y).sum() - (predictions(spark, model, mixed) == y).sum()) / known.sum())
    for f, values in falls.items():
        assert got[f] == pytest.approx((np.mean(values), np.std(values)), abs=1e-12)
