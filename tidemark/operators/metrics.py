"""Confusion counts, ratios, curves, sweeps and threshold selection.

Thresholds never cause a second look at the scores. Scores are reduced once, either to one row
per distinct score (exact curves) or to one row per interval of a threshold grid (sweeps), and
everything else is arithmetic on cumulative counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions.scalars import ratio
from tidemark.operators.index import CHUNK, rolling, running_sums_by, trailing


def linspace(a: float, b: float, n: int) -> list[float]:
    step = (b - a) / (n - 1)
    return [a + i * step for i in range(n - 1)] + [b]


def confusion(df: DataFrame, hit: Column, label: str = "y", by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn; counted also when a class or an outcome is missing."""
    y = F.col(label) == 1
    parts = {"tp": hit & y, "fp": hit & ~y, "tn": ~hit & ~y, "fn": ~hit & y}
    aggs = [F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long")).alias(n) for n, c in parts.items()]
    return (df.groupBy(*by) if by else df).agg(*aggs)


def with_rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1, accuracy, TPR, FPR and FNR from the counts; 0 where undefined."""
    c = F.col
    p = ratio(c("tp"), c("tp") + c("fp"))
    r = ratio(c("tp"), c("tp") + c("fn"))
    n = c("tp") + c("fp") + c("tn") + c("fn")
    return df.select(
        "*",
        p.alias("precision"),
        r.alias("recall"),
        ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"),
        ratio(c("tp") + c("tn"), n).alias("accuracy"),
        r.alias("tpr"),
        ratio(c("fp"), c("fp") + c("tn")).alias("fpr"),
        ratio(c("fn"), c("tp") + c("fn")).alias("fnr"),
    )


def classification_report(df: DataFrame, hit: Column, label: str = "y") -> DataFrame:
    """Rows per class plus macro and weighted averages: precision, recall, f1, support."""
    c = F.col
    pos = with_rates(confusion(df, hit, label))
    neg = with_rates(pos.select(c("tn").alias("tp"), c("fn").alias("fp"), c("tp").alias("tn"), c("fp").alias("fn")))
    cols = ["precision", "recall", "f1"]
    one = pos.select(F.lit("1").alias("class"), *cols, (c("tp") + c("fn")).alias("support"))
    zero = neg.select(F.lit("0").alias("class"), *cols, (c("tp") + c("fn")).alias("support"))
    both = zero.unionByName(one)
    macro = both.agg(*[F.avg(k).alias(k) for k in cols], F.sum("support").alias("support"))
    weighted = both.agg(
        *[ratio(F.sum(c(k) * c("support")), F.sum("support")).alias(k) for k in cols], F.sum("support").alias("support")
    )
    return both.unionByName(macro.withColumn("class", F.lit("macro"))).unionByName(
        weighted.withColumn("class", F.lit("weighted"))
    )


def score_curve(df: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """One row per distinct score, highest first: counts and cumulative tp, fp with totals.

    Distinct scores may be as many as rows, so the cumulative counts are carried across range
    partitions rather than computed in one ordered task.
    """
    pos = (F.col(label) == 1).cast("long")
    counts = df.groupBy((-F.col(score)).alias("_neg")).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    cum = running_sums_by(counts, ["_neg"], {"tp": F.col("pos"), "fp": F.col("neg")})
    totals = counts.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return attach(cum.withColumn("threshold", -F.col("_neg")).drop("_neg"), totals)


def roc_points(curve: DataFrame) -> DataFrame:
    c = F.col
    return curve.select(
        "threshold", "tp", "fp", ratio(c("tp"), c("n_pos")).alias("tpr"), ratio(c("fp"), c("n_neg")).alias("fpr")
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """Trapezoid area: each distinct score adds neg · (tp before + pos/2)."""
    c = F.col
    area = F.sum(c("neg") * (c("tp") - c("pos") / 2.0))
    return curve.agg(ratio(area, F.max("n_pos") * F.max("n_neg")).alias("roc_auc"))


def pr_points(curve: DataFrame) -> DataFrame:
    c = F.col
    return curve.select(
        "threshold",
        "tp",
        "fp",
        ratio(c("tp"), c("tp") + c("fp")).alias("precision"),
        ratio(c("tp"), c("n_pos")).alias("recall"),
    )


def with_end_point(points: DataFrame) -> DataFrame:
    """Precision-recall points and the conventional end of the curve: precision 1, recall 0, no threshold."""
    end = points.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def average_precision(curve: DataFrame) -> DataFrame:
    """Σ (Rₙ − Rₙ₋₁)·Pₙ over distinct scores."""
    c = F.col
    return curve.agg(
        ratio(F.sum(c("pos") * c("tp") / (c("tp") + c("fp"))), F.max("n_pos").cast("double")).alias("average_precision")
    )


def grid_cell(score: Column, ts: list[float]) -> Column:
    """How many thresholds of an ascending grid the score reaches.

    On an even grid the cell is computed and then set right by one comparison on each side, so
    the outcome is that of ``score >= t`` itself; other grids are short and are counted.
    """
    n = len(ts)
    step = (ts[-1] - ts[0]) / (n - 1) if n > 1 else 0.0
    even = n > 8 and step > 0 and all(abs(b - a - step) < step * 1e-6 for a, b in zip(ts, ts[1:]))
    if not even:
        return sum((F.when(score >= t, 1).otherwise(0) for t in ts), F.lit(0))
    grid = F.array(*[F.lit(t) for t in ts])
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.floor((score - ts[0]) / step).cast("int") + 1))
    down = F.when((guess > 0) & (score < F.element_at(grid, F.greatest(guess, F.lit(1)))), 1).otherwise(0)
    up = F.when((guess < n) & (score >= F.element_at(grid, F.least(guess + 1, F.lit(n)))), 1).otherwise(0)
    return guess - down + up


def sweep(df: DataFrame, grid: list[float], score: str = "p", label: str = "y", by: list[str] | None = None) -> DataFrame:
    """Counts at every threshold of a grid (``score >= t``) in one pass over the scores.

    Each score falls in the interval above the highest threshold it reaches; counts per interval
    are summed from the top. Work after the first aggregation is on ``len(grid)`` rows per group.
    """
    by = by or []
    ts = sorted(set(grid))
    reached = grid_cell(F.col(score), ts)
    pos = (F.col(label) == 1).cast("long")
    cells = df.groupBy(*by, reached.alias("_cell")).agg(F.sum(pos).alias("_pos"), F.sum(1 - pos).alias("_neg"))
    per = cells.groupBy(*by).agg(
        F.collect_list(F.struct("_cell", "_pos", "_neg")).alias("_cells"),  # at most one per grid interval
        F.sum("_pos").alias("_np"),
        F.sum("_neg").alias("_nn"),
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(ts)])
    out = per.select("*", F.inline(steps))

    def above(field: str) -> Column:
        return F.aggregate(
            "_cells", F.lit(0).cast("long"), lambda s, x: s + F.when(x["_cell"] >= F.col("i"), x[field]).otherwise(0)
        )

    out = out.select(*by, "threshold", above("_pos").alias("tp"), above("_neg").alias("fp"), "_np", "_nn")
    return out.select(
        *by, "threshold", "tp", "fp", (F.col("_nn") - F.col("fp")).alias("tn"), (F.col("_np") - F.col("tp")).alias("fn")
    )


def sweep_table(df: DataFrame, thresholds: DataFrame, score: str = "p", label: str = "y", strict: bool = False) -> DataFrame:
    """Counts at every row of ``thresholds`` (all its columns are kept), however many: ``score >= threshold``, or ``>`` if ``strict``.

    Distinct scores and thresholds stand on one line, highest first, and a threshold's hits are the running
    sums up to it, carried across range partitions. A null score is under every threshold, NaN over.
    """
    pos = (F.col(label) == 1).cast("long")
    low = lambda c: F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(-F.col(c).cast("double"))
    counts = df.groupBy(low(score).alias("_neg")).agg(F.sum(pos).alias("_pos"), F.sum(1 - pos).alias("_not"))
    totals = counts.agg(F.coalesce(F.sum("_pos"), F.lit(0)).alias("_np"), F.coalesce(F.sum("_not"), F.lit(0)).alias("_nn"))
    marks = thresholds.select(F.struct("*").alias("_given"), low("threshold").alias("_neg"), F.lit(0).cast("long").alias("_pos"), F.lit(0).cast("long").alias("_not"))
    scores = counts.filter("_neg IS NOT NULL").select(F.lit(None).cast(marks.schema["_given"].dataType).alias("_given"), "_neg", "_pos", "_not")
    # Of equals, scores come before the thresholds that they reach.
    line = scores.withColumn("_at", F.lit(int(strict))).unionByName(marks.withColumn("_at", F.lit(int(not strict))))
    cum = running_sums_by(line, ["_neg", "_at"], {"tp": F.col("_pos"), "fp": F.col("_not")}).filter("_given IS NOT NULL")
    out = attach(cum.select("_given.*", "tp", "fp"), totals)
    return out.withColumns({"tn": F.col("_nn") - F.col("fp"), "fn": F.col("_np") - F.col("tp")}).drop("_np", "_nn")


def best(df: DataFrame, metric: Column, tie: Column, n: int = 1) -> DataFrame:
    """Row with the highest metric; among equals the lowest ``tie``. A top-k, not a sort."""
    return df.orderBy(metric.desc(), tie.asc()).limit(n)


def trailing_vote(scores: DataFrame, threshold: float, n: int = 3, k: int = 2, by: str = "window_id", chunk: int = CHUNK) -> DataFrame:
    """1 where at least ``k`` of the last ``n`` scores reach the threshold (short frames at the start)."""
    hits = F.sum((F.col("p") >= threshold).cast("int")).over(trailing(n, by))
    out = rolling(scores, {"_hits": hits}, n - 1, chunk=chunk, by=by)
    return out.withColumn("vote", (F.col("_hits") >= k).cast("int")).drop("_hits")


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over the overall range, with counts and the empirical distribution."""
    by = by or []
    v = F.col(value)
    span = df.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    cell = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    counts = (
        attach(df, span)
        .groupBy(*by, cell.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), (F.first("_lo") + F.first(width) * F.first(cell)).alias("left_edge"))
    )
    w = Window.partitionBy(*by).orderBy("bin") if by else Window.orderBy("bin")  # rows: classes × bins
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return counts.withColumn("cdf", F.sum("n").over(w) / F.sum("n").over(whole))
