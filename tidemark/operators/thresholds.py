"""Choosing thresholds from curves and sweeps, and comparing what they give.

Selections are top-1 queries with a stated tie rule: the lowest threshold on precision-recall
curves and grids, the highest on ROC curves, as a first-maximum scan would give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions.scalars import ratio
from tidemark.operators.metrics import best, confusion, linspace, sweep, with_rates

EPS = 1e-8
COST_GRID = linspace(0.1, 0.9, 81)
MISSION_GRID = linspace(0.1, 0.95, 85)
PRECISION_GRID = [0.85 + i * 0.001 for i in range(149)]
PER_HOUR = 600  # assumed samples per hour


def youden(roc: DataFrame) -> DataFrame:
    """Threshold with the largest TPR − FPR."""
    j = F.col("tpr") - F.col("fpr")
    return roc.withColumn("j", j).orderBy(F.col("j").desc(), F.col("threshold").desc()).limit(1)


def f1_optimal(pr: DataFrame, epsilon: float = EPS) -> DataFrame:
    """Point of the precision-recall curve with the highest F1 (``epsilon`` in the denominator)."""
    p, r = F.col("precision"), F.col("recall")
    f1 = 2 * (p * r) / (p + r + epsilon) if epsilon else ratio(2 * p * r, p + r)
    return best(pr.withColumn("f1", f1), F.col("f1"), F.col("threshold"))


def cost_optimal(counts: DataFrame, fp_cost: float = 1.0, fn_cost: float = 10.0) -> DataFrame:
    cost = F.col("fp") * fp_cost + F.col("fn") * fn_cost
    return best(counts.withColumn("cost", cost), -F.col("cost"), F.col("threshold"))


def mission_cost(counts: DataFrame, fn_cost: float = 10.0, fp_cost: float = 1.0, hours: float = 24.0) -> DataFrame:
    """Missed events cost by count, false alarms by their daily rate."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    daily = F.col("fp") / n * PER_HOUR * hours
    cost = F.col("fn") * fn_cost + daily * fp_cost
    return best(counts.withColumn("cost", cost), -F.col("cost"), F.col("threshold"))


def high_precision(pr: DataFrame, target: float = 0.9, compat: bool = False) -> DataFrame:
    """Best recall among points with precision ≥ target, or ≥ 95 % of the best precision there is.

    ``compat`` gives the F1 optimum, which is what results of the older form show.
    """
    if compat:
        return f1_optimal(pr)
    top = pr.agg(F.max("precision").alias("_top"))
    need = F.when(F.col("_top") >= target, F.lit(target)).otherwise(F.col("_top") * 0.95)
    ok = attach(pr, top).filter(F.col("precision") >= need).drop("_top")
    return best(ok, F.col("recall"), F.col("threshold"))


def high_recall(pr: DataFrame, target: float = 0.9, compat: bool = False) -> DataFrame:
    """Best precision among points with recall ≥ target, or ≥ 95 % of the best recall there is."""
    if compat:
        return f1_optimal(pr)
    top = pr.agg(F.max("recall").alias("_top"))
    need = F.when(F.col("_top") >= target, F.lit(target)).otherwise(F.col("_top") * 0.95)
    ok = attach(pr, top).filter(F.col("recall") >= need).drop("_top")
    return best(ok, F.col("precision"), F.col("threshold"))


def rule_picks(rates: DataFrame, min_precision: float = 0.1, min_recall: float = 0.5) -> DataFrame:
    """Four named picks from a sweep: F1, recall under a precision floor, precision under a recall floor, balance."""
    p, r, t = F.col("precision"), F.col("recall"), F.col("threshold")
    cols = ["threshold", "precision", "recall", "f1", "fpr"]
    picks = {
        "max_f1": best(rates, F.col("f1"), t),
        "high_precision": best(rates.filter(p >= min_precision), r, t),
        "high_recall": best(rates.filter(r >= min_recall), p, t),
        "balanced": best(rates, 1 - F.abs(p - r), t),
    }
    out = None
    for name, df in picks.items():
        row = df.select(F.lit(name).alias("rule"), *cols)
        out = row if out is None else out.unionByName(row)
    return out


def precision_target(rates: DataFrame, target: float | None = None) -> DataFrame:
    """Best recall with precision ≥ target, else best precision; thresholds without a hit are skipped."""
    live = rates.filter((F.col("tp") + F.col("fp")) > 0)
    if target is None:
        return best(live, F.col("precision"), F.col("threshold"))
    meets = (F.col("precision") >= target).cast("int")
    # Rows that meet the target come first and are ranked by recall, the others by precision.
    rank = F.when(meets == 1, F.col("recall")).otherwise(F.col("precision"))
    return live.orderBy(meets.desc(), rank.desc(), F.col("threshold")).limit(1)


def fp_per_hour(fp: Column, n: Column) -> Column:
    return fp / n * PER_HOUR


def recommendation_score(precision: Column, recall: Column, f1: Column, fp_hour: Column) -> Column:
    """3·P + 2·(R − 0.3) or −1, plus up to 2 for few false alarms, plus F1."""
    return (
        precision * 3
        + F.when(recall > 0.3, (recall - 0.3) * 2).otherwise(-1)
        + F.when(fp_hour < 15, (15 - fp_hour) / 15 * 2).otherwise(0)
        + f1
    )


def recommend(named: DataFrame, min_recall: float | None = None, max_fp_hour: float | None = None) -> DataFrame:
    """One of a few named thresholds: by weighted score, or by best precision within constraints."""
    if min_recall is None:
        s = recommendation_score(F.col("precision"), F.col("recall"), F.col("f1"), F.col("fp_per_hour"))
        return best(named.withColumn("score", s), F.col("score"), F.col("rank"))
    valid = ((F.col("recall") >= min_recall) & (F.col("fp_per_hour") <= max_fp_hour)).cast("int")
    key = F.when(valid == 1, F.col("precision")).otherwise(F.col("f1"))
    return named.withColumn("score", key).orderBy(valid.desc(), F.col("score").desc(), F.col("rank")).limit(1)


def mission_rates(counts: DataFrame) -> DataFrame:
    """Missed share, energy saved by not acting, and share of true events kept."""
    c = F.col
    n = c("tp") + c("fp") + c("tn") + c("fn")
    return counts.select(
        "*",
        (c("fn") / n * 100).alias("missed_rate"),
        ((c("tn") + c("fn")) / n).alias("energy_saved"),
        ratio(c("tp"), c("tp") + c("fn")).alias("data_quality"),
    )


def compare(baseline: DataFrame, new: DataFrame, metrics: list[str]) -> DataFrame:
    """Metric by metric: change, percent and verdict of two one-row results."""
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("baseline"), F.col(f"_new_{m}").alias("new")) for m in metrics
    ])
    both = attach(baseline, new.select([F.col(m).alias(f"_new_{m}") for m in metrics])).select(F.inline(pairs))
    change = F.col("new") - F.col("baseline")
    return both.select(
        "*",
        change.alias("change"),
        F.when(F.col("baseline") > 0, change / F.col("baseline") * 100).otherwise(0.0).alias("change_pct"),
        F.when(change > 0, "IMPROVED").when(change < 0, "WORSE").otherwise("SAME").alias("status"),
    )


def winners(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Per metric, the model with the highest value (among equals the first by ``rank``)."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])
    long = rows.select("model", "rank", F.inline(pairs))
    return long.groupBy("metric").agg(F.max(F.struct("value", -F.col("rank"), "model")).alias("w")).select(
        "metric", F.col("w.model").alias("winner"), F.col("w.value").alias("value")
    )


def nearest_threshold(left: DataFrame, right: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """First row of ``right`` within ``tolerance`` of the threshold of ``left``, which has one row."""
    r = right.select([F.col(c).alias(f"other_{c}") for c in right.columns])
    near = F.abs(F.col("other_threshold") - F.col("threshold")) < tolerance
    return attach(r, left).filter(near).orderBy("other_threshold").limit(1)


def frozen_test(scores: DataFrame, tuned: DataFrame, by: str = "model") -> DataFrame:
    """Score each model's test rows once at the threshold its validation rows chose."""
    joined = scores.join(tuned.select(by, "threshold"), by)
    return with_rates(confusion(joined, F.col("p") >= F.col("threshold"), by=[by, "threshold"]))


def tune_by_f1(val_scores: DataFrame, grid: list[float], by: str = "model") -> DataFrame:
    rates = with_rates(sweep(val_scores, grid, by=[by]))
    top = F.max(F.struct("f1", (-F.col("threshold")).alias("_t"), "precision", "recall"))
    return rates.groupBy(by).agg(top.alias("_b")).select(
        by, (-F.col("_b._t")).alias("threshold"), F.col("_b.f1").alias("f1")
    )
