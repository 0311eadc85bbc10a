"""Model operators on Spark ML: forests, boosting, scoring, importance, calibration, gates.

Splits are by time throughout. Evaluation goes through the sweep and curve operators, so a model
adds one scored table and nothing is pulled to the driver but metrics and importances.
"""

from __future__ import annotations

from functools import reduce
from math import gcd
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.operators.forests import Forest
from tidemark.operators.index import CHUNK, exact_percentiles, renumber
from tidemark.operators.metrics import confusion, with_rates
from tidemark.session import materialise

SEED = 42
#: The categories of the fifteen features.
FAMILIES = {
    "Temporal Features": ["overall_slope", "first_half_slope", "second_half_slope", "trend_consistency"],
    "Pressure Dynamics": ["pressure_drop", "drop_rate", "min_position"],
    "Statistical Measures": ["mean", "std", "range", "first_half_mean", "second_half_mean", "mean_ratio"],
    "Anomaly Detection": ["min_zscore", "anomaly_strength"],
}


def balanced_weights(df: DataFrame, label: str = "y") -> DataFrame:
    """Add ``weight`` = n / (2·n_class). The class table has one row per class."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = Window.partitionBy(F.lit(0))
    sizes = sizes.select(label, (F.sum("_c").over(total) / (2 * F.col("_c"))).alias("weight"))
    return df.join(F.broadcast(sizes), label)


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def forest(features: list[str], trees: int = 100, depth: int = 15, leaf: int = 5, label: str = "y") -> Pipeline:
    rf = RandomForestClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", seed=SEED,
        # Deep trees: keep each row's node with the row, and grow more nodes per pass.
        cacheNodeIds=True, maxMemoryInMB=1024,
    )
    return Pipeline(stages=[assembler(features), rf])


def spread(df: DataFrame) -> DataFrame:
    """``df`` stored in even parts, one for each core: fitting passes over its rows many times, and each pass waits for the largest part."""
    return materialise(df.repartition(df.sparkSession.sparkContext.defaultParallelism))


def fit_forest(train: DataFrame, features: list[str], label: str = "y", **kw) -> PipelineModel:
    """Forest on rows that weigh the same by class. The weighted rows are stored first, so that no pass of the fit makes them again.

    Two classes, 0 and 1, are fitted by :mod:`tidemark.operators.bagging`, other labels by the library.
    """
    from tidemark.operators import bagging  # it builds on the bins of the boosting, which needs this module

    rows = spread(balanced_weights(train, label).select(*features, label, "weight"))
    classes = {r[0]: r[1] for r in rows.groupBy(label).agg(F.max("weight")).filter(F.col(label).isNotNull()).limit(3).collect()}
    if not {1} <= set(classes) <= {0, 1}:
        return forest(features, label=label, **kw).fit(rows)
    finite = [F.coalesce(F.abs(F.col(f).cast("double")) < float("inf"), F.lit(False)) for f in features]  # NaN is above all
    if rows.filter(~reduce(and_, finite)).limit(1).count():
        raise ValueError("feature values must not be missing, NaN or infinite")
    return PipelineModel([assembler(features), bagging.fit(rows.withColumnRenamed(label, "y"), features, classes, **kw)])


def boosted(features: list[str], rounds: int = 100, depth: int = 4, rate: float = 0.1, sample: float = 0.8, label: str = "y") -> Pipeline:
    """Boosted trees that stop on the loss of rows where ``is_val`` is true."""
    gbt = GBTClassifier(
        labelCol=label, featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=rate,
        subsamplingRate=sample, validationIndicatorCol="is_val", seed=SEED,
    )
    return Pipeline(stages=[assembler(features), gbt])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score table: input columns and ``p``, the probability of class 1."""
    out = model.transform(df)
    return out.select(*df.columns, vector_to_array("probability").getItem(1).alias("p"))


def fit_boosted(train: DataFrame, val: DataFrame, features: list[str], **kw) -> PipelineModel:
    """Positives weigh as the negative-to-positive ratio of the training rows."""
    counts = train.agg(F.sum(F.col("y")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    both = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    ratio = F.when(F.col("y") == 1, F.try_divide(F.col("_n") - F.col("_p"), F.col("_p"))).otherwise(1.0)
    weighted = attach(both, counts).withColumn("weight", F.coalesce(ratio, F.lit(1.0))).drop("_p", "_n")
    return boosted(features, **kw).fit(weighted)


def grid_search(
    train: DataFrame, val: DataFrame, features: list[str], grid: list[dict], threshold: float = 0.5, kind: str = "forest"
):
    """Fit every setting on the training period; rank by validation F1. Returns (best model, results).

    ``kind`` is ``forest`` or ``boosted``; a setting holds the keyword arguments of :func:`forest` or
    :func:`boosted`. Fits run one after another, each spread over the cluster.
    """
    weighted = materialise(balanced_weights(train).select(*features, "y", "weight"))
    best_model, best_f1, rows = None, -1.0, []
    for setting in grid:
        model = forest(features, **setting).fit(weighted) if kind == "forest" else fit_boosted(train, val, features, **setting)
        r = with_rates(confusion(score(model, val), F.col("p") >= threshold)).head()
        rows.append((*(float(v) for v in setting.values()), r["precision"], r["recall"], r["f1"]))
        if r["f1"] > best_f1:
            best_model, best_f1 = model, r["f1"]
    names = [*grid[0], "precision", "recall", "f1"]
    results = train.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    return best_model, results.orderBy(F.desc("f1"))


def time_folds(df: DataFrame, rows: DataFrame, folds: int = 5, by: str = "end_idx") -> DataFrame:
    """Cut time in ``folds + 1`` equal parts; ``fold`` k trains on parts < k and tests on part k."""
    part = F.floor(F.col(by) * (folds + 1) / F.col("_n")).cast("int")
    return attach(df, rows).withColumn("fold", part).drop("_n")


def forward_chain(folded: DataFrame, features: list[str], folds: int = 5, threshold: float = 0.5, **kw) -> DataFrame:
    """Forward-chaining validation: one row of rates per fold."""
    out = None
    for k in range(1, folds + 1):
        model = fit_forest(folded.filter(F.col("fold") < k), features, **kw)
        rates = with_rates(confusion(score(model, folded.filter(F.col("fold") == k)), F.col("p") >= threshold))
        rates = rates.withColumn("fold", F.lit(k))
        out = rates if out is None else out.unionByName(rates)
    return out


def ranked_share(importances: DataFrame, value: str, name: str = "feature") -> DataFrame:
    """Place and cumulative share, largest first (one row per feature)."""
    w = Window.orderBy(F.desc(value), name)
    whole = F.sum(value).over(Window.partitionBy(F.lit(0)))
    return importances.select(
        "*",
        F.row_number().over(w).cast("long").alias("place"),
        F.try_divide(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), whole).alias("cumulative_share"),
    )


def importance_table(model: PipelineModel, features: list[str], spark) -> DataFrame:
    """Impurity importance per feature with its family, place and cumulative share."""
    family = {f: fam for fam, fs in FAMILIES.items() for f in fs}
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, family.get(f, "other"), float(v)) for f, v in zip(features, values)]
    return ranked_share(spark.createDataFrame(rows, "feature string, family string, importance double"), "importance")


def family_importance(importances: DataFrame) -> DataFrame:
    return importances.groupBy("family").agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("features"))


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: list[str], key: str = "window_id", repeats: int = 3, label: str = "y", chunk: int = CHUNK
) -> DataFrame:
    """Fall of accuracy when one feature is shuffled: mean and deviation over repeats.

    Rows are numbered densely and each repeat pairs row i with row (a·i + b) mod n, a coprime to n.
    One equi-join per repeat brings the donor row; a row's path through each tree is walked once, and again only
    where a donor's value leaves it (:mod:`tidemark.operators.forests`).
    """
    spark = df.sparkSession
    rows = materialise(renumber(df.select(key, label, *features), "_i", by=key, chunk=chunk))
    n = rows.count()
    values = F.array(*[F.col(f).cast("double") for f in features])
    paired = rows.select("_i", label, values.alias("_x"))
    donors = [f"_d{r}" for r in range(repeats)]
    for r, name in enumerate(donors):
        a = max(1, int(n * 0.6180339887) + r)
        while gcd(a, n) != 1:
            a += 1
        at = (F.col("_i") * F.lit(a) + F.lit(7919 * (r + 1))) % F.lit(max(n, 1))
        paired = paired.join(rows.select(at.alias("_i"), values.alias(name)), "_i")
    # Few bytes and much work a row: parts by size alone would leave cores idle.
    paired = paired.repartition(2 * spark.sparkContext.defaultParallelism)
    counted = Forest.of(model.stages[-1], features, spark).count_hits(paired, "_x", donors, label)
    out = counted.select("repeat", "_j", F.try_divide("hits", "n").alias("acc"))
    out = materialise(out)  # one row per repeat and feature, read twice
    base = out.filter("_j = -1").select("repeat", F.col("acc").alias("_base"))
    names = F.array(*[F.lit(f) for f in features])
    falls = out.filter("_j >= 0").join(F.broadcast(base), "repeat")
    return falls.groupBy(F.get(names, F.col("_j")).alias("feature")).agg(
        F.avg(F.col("_base") - F.col("acc")).alias("mean_drop"), F.stddev_pop(F.col("_base") - F.col("acc")).alias("std_drop")
    )


def calibrate(train_scores: DataFrame, scores: DataFrame, method: str = "isotonic") -> DataFrame:
    """Calibrated probability next to the raw score, by isotonic regression or a sigmoid on the logit."""
    eps = 1e-10
    if method == "isotonic":
        # One weighted point per distinct score gives the same fit from far fewer points.
        points = train_scores.groupBy("p").agg(F.avg("y").alias("y"), F.count(F.lit(1)).cast("double").alias("w"))
        reg = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w", predictionCol="calibrated")
        return reg.fit(points).transform(scores)
    clipped = F.least(F.greatest(F.col("p"), F.lit(eps)), F.lit(1 - eps))
    logit = array_to_vector(F.array(F.log(clipped / (1 - clipped))))
    lr = LogisticRegression(featuresCol="_logit", labelCol="y", probabilityCol="_prob", predictionCol="_pred", rawPredictionCol="_raw")
    model = lr.fit(train_scores.withColumn("_logit", logit))
    out = model.transform(scores.withColumn("_logit", logit))
    return out.select(*scores.columns, vector_to_array("_prob").getItem(1).alias("calibrated"))


def reconstruction_gate(train_windows: DataFrame, windows: DataFrame, samples: str = "samples", k: int = 16) -> DataFrame:
    """Mean squared reconstruction error of scaled windows through ``k`` principal components.

    The linear stand-in for a bottleneck network; no inverse transform has to be computed.
    """
    vec = array_to_vector(F.col(samples))
    scaler = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True)
    pca = PCA(k=k, inputCol="_std", outputCol="_pc")
    model = Pipeline(stages=[scaler, pca]).fit(train_windows.select(vec.alias("_raw")))
    out = model.transform(windows.withColumn("_raw", vec))
    out = out.withColumn("_x", vector_to_array("_std")).withColumn("_z", vector_to_array("_pc"))
    # Components are orthonormal: |x − Pz|² = |x|² − |z|².
    norm = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v)
    err = F.greatest(norm("_x") - norm("_z"), F.lit(0.0)) / F.size("_x")
    return out.select(*windows.columns, err.alias("gate_score"))


def keep_top(df: DataFrame, score_col: str, label: str = "y", percent: float = 50.0, per_class: bool = True) -> DataFrame:
    """Rows at or above the (100 − percent) percentile of the gate score, per class or overall.

    Falls back to the overall threshold when a class has no scored row.
    """
    q = (100 - percent) / 100
    overall = exact_percentiles(df, score_col, [q]).select(F.col(score_col).alias("_all"))
    if not per_class:
        return attach(df, overall).filter(F.col(score_col) >= F.col("_all")).drop("_all")
    per = exact_percentiles(df, score_col, [q], by=label).select(label, F.col(score_col).alias("_t"))
    classes = per.agg(F.count(F.lit(1)).alias("_k"))
    joined = attach(df.join(per, label, "left"), overall, classes)
    cut = F.when(F.col("_k") >= 2, F.col("_t")).otherwise(F.col("_all"))
    return joined.filter(F.col(score_col) >= cut).select(*df.columns)


def keep_above(df: DataFrame, score_col: str, threshold: float | None = None) -> DataFrame:
    """Rows at or above a fixed threshold, or the median score."""
    if threshold is not None:
        return df.filter(F.col(score_col) >= threshold)
    return keep_top(df, score_col, percent=50.0, per_class=False)


def anomaly_threshold(normal: DataFrame, score_col: str, q: float = 0.95) -> DataFrame:
    """One row: the ``q`` percentile of the normal rows' errors."""
    return exact_percentiles(normal, score_col, [q]).select(F.col(score_col).alias("threshold"))


def flag_anomalies(df: DataFrame, threshold: DataFrame, score_col: str) -> DataFrame:
    return attach(df, threshold).withColumn("anomaly", F.col(score_col) > F.col("threshold")).drop("threshold")


def two_stage(df: DataFrame, gate: Column, second: Column) -> DataFrame:
    """Second-stage score where the gate lets a row through, 0 elsewhere."""
    return df.select("*", gate.alias("passed"), F.when(gate, second).otherwise(F.lit(0.0)).alias("score"))


def filtered_ratio(df: DataFrame) -> DataFrame:
    passed = F.sum(F.col("passed").cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n"), passed.alias("passed"), (1 - F.try_divide(passed, F.count(F.lit(1)))).alias("filtered_ratio"))


def select_features(importances: DataFrame, correlations: DataFrame, floor: float = 0.01, limit: float = 0.95) -> DataFrame:
    """Important features, less the weaker of each highly correlated pair.

    Both inputs are feature-sized. Every pair above the limit drops its less important member,
    the second one when they are equal.
    """
    keep = importances.filter(F.col("importance") >= floor).select("feature", "importance")
    a = keep.select(F.col("feature").alias("f1"), F.col("importance").alias("i1"))
    b = keep.select(F.col("feature").alias("f2"), F.col("importance").alias("i2"))
    close = correlations.filter(F.abs("r") > limit).join(F.broadcast(a), "f1").join(F.broadcast(b), "f2")
    weaker = close.select(F.when(F.col("i1") < F.col("i2"), F.col("f1")).otherwise(F.col("f2")).alias("feature"))
    return keep.join(F.broadcast(weaker.distinct()), "feature", "left_anti")


def standardise(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns to zero mean and unit population deviation of the training rows; constants become 0."""
    stats = train.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    scaled = {
        c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)) for c in columns
    }
    out = attach(df, stats).withColumns(scaled)
    return out.select(*df.columns)
