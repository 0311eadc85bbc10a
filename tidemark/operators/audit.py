"""Quality and leakage audits. Each is one aggregation over the data, then arithmetic on its row."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions.scalars import ratio, safe_corr
from tidemark.operators.aggregates import correlation_matrix, long_features
from tidemark.operators.index import CHUNK, in_chunk, rolling

SUSPICIOUS = ("label", "target", "gt_", "ground_truth", "vortex", "event")
KEY_FEATURES = ("mean", "std", "pressure_drop", "min_zscore")


def order_violations(df: DataFrame, columns: list[str], by: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """How often each column falls from one row to the next in ``by`` order."""
    falls = {f"_f_{c}": (F.col(c) < F.lag(c).over(in_chunk(by))).cast("long") for c in columns}
    steps = rolling(df.select(by, *columns), falls, 1, chunk=chunk, by=by)
    return steps.agg(*[F.coalesce(F.sum(f"_f_{c}"), F.lit(0).cast("long")).alias(f"{c}_falls") for c in columns])


def repeated_clocks(stream: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows whose clock equals the one before. The stream is in clock order, so no grouping is needed."""
    same = (F.col("sclk") == F.lag("sclk").over(in_chunk())).cast("long")
    return rolling(stream.select("idx", "sclk"), {"_same": same}, 1, chunk=chunk).agg(
        F.coalesce(F.sum("_same"), F.lit(0).cast("long")).alias("repeated_clocks")
    )


def row_quality(stream: DataFrame, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """Nulls per column, pressure range, 3σ outliers, order violations and repeated clocks."""
    stats = stream.agg(F.avg("pressure").alias("_m"), F.stddev_samp("pressure").alias("_s"))
    far = F.abs(F.col("pressure") - F.col("_m")) > 3 * F.col("_s")
    base = attach(stream, stats).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}_nulls") for c in columns],
        F.min("pressure").alias("min_pressure"), F.max("pressure").alias("max_pressure"),
        F.sum(far.cast("long")).alias("outliers"),
    )
    return attach(base, order_violations(stream, ["sclk"], chunk=chunk), repeated_clocks(stream, chunk))


def data_warnings(stream: DataFrame, columns: list[str], flag: str = "gt_detection_win", chunk: int = CHUNK) -> DataFrame:
    """One row per warning: nulls, infinities, constant or tiny range, repeated clocks, imbalance."""
    numeric = [c for c, t in stream.dtypes if c in columns and t == "double"]
    inf = [F.sum((F.abs(c) == float("inf")).cast("long")).alias(f"_inf_{c}") for c in numeric]
    row = stream.agg(
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"_null_{c}") for c in columns],
        *inf,
        (F.max("pressure") - F.min("pressure")).alias("_range"),
        F.avg(F.col(flag).cast("double")).alias("_rate"),
    )
    row = attach(row, repeated_clocks(stream, chunk))

    def warn(cond: Column, kind: str, what: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(what).alias("subject"), value.cast("double").alias("value")))

    span, rate = F.col("_range"), F.col("_rate")
    checks = [warn(F.col(f"_null_{c}") > 0, "missing", c, F.col(f"_null_{c}")) for c in columns]
    checks += [warn(F.col(f"_inf_{c}") > 0, "infinite", c, F.col(f"_inf_{c}")) for c in numeric]
    checks += [
        warn(span == 0, "constant", "pressure", span),
        warn((span > 0) & (span < 0.1), "tiny_range", "pressure", span),
        warn(F.col("repeated_clocks") > 0, "repeated_clocks", "sclk", F.col("repeated_clocks")),
        warn((rate < 0.1) | (rate > 0.9), "imbalance", flag, rate),
    ]
    return row.select(F.inline(F.array_compact(F.array(*checks))))


def matrix_warnings(df: DataFrame, features: list[str], limit: float = 0.95) -> DataFrame:
    """NaN or null, infinite and constant features, and pairs correlated beyond ``limit``."""
    v = F.col("value")
    per = long_features(df, features).groupBy("feature").agg(
        F.sum((v.isNull() | F.isnan(v)).cast("long")).alias("_nan"),
        F.sum((F.abs(v) == float("inf")).cast("long")).alias("_inf"),
        F.stddev_pop(v).alias("_std"),
    )

    def warn(cond: Column, kind: str, value: Column) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.col("feature").alias("subject"), value.cast("double").alias("value")))

    single = per.select(
        F.inline(
            F.array_compact(
                F.array(
                    warn(F.col("_nan") > 0, "nan", F.col("_nan")),
                    warn(F.col("_inf") > 0, "infinite", F.col("_inf")),
                    warn(F.col("_std") == 0, "constant", F.col("_std")),
                )
            )
        )
    )
    pairs = correlation_matrix(df, features).filter(F.abs("r") > limit)
    return single.unionByName(
        pairs.select(F.lit("correlated").alias("kind"), F.concat_ws("~", "f1", "f2").alias("subject"), F.col("r").alias("value"))
    )


def window_integrity(windows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Duplicate ids and rows, chronology violations and clock ranges of a sliding-window table."""
    cols = ["window_id", "start_idx", "end_idx", "start_sclk", "end_sclk", "label"]
    rows = windows.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    ids = rows.groupBy("window_id").agg(F.sum("_c").alias("_c"))
    out = rows.agg(
        F.sum("_c").alias("n_rows"), F.sum(F.col("_c") - 1).alias("duplicate_rows"),
        F.min("start_sclk").alias("first_start"), F.max("start_sclk").alias("last_start"),
        F.min("end_sclk").alias("first_end"), F.max("end_sclk").alias("last_end"),
    )
    falls = order_violations(windows, ["start_sclk", "end_sclk"], by="window_id", chunk=chunk)
    return (
        attach(out, ids.agg(F.sum(F.col("_c") - 1).alias("duplicate_ids")), falls)
        .withColumn("chronology_violations", F.col("start_sclk_falls") + F.col("end_sclk_falls"))
        .drop("start_sclk_falls", "end_sclk_falls")
    )


def range_comparison(windows: DataFrame, earlier: str = "val", later: str = "test") -> DataFrame:
    """Whether one split ends before the other starts, by clock and by index."""
    e, l = F.col("split") == earlier, F.col("split") == later
    out = windows.agg(
        F.max(F.when(e, F.col("end_sclk"))).alias("earlier_end_sclk"), F.min(F.when(l, F.col("start_sclk"))).alias("later_start_sclk"),
        F.max(F.when(e, F.col("end_idx"))).alias("earlier_end_idx"), F.min(F.when(l, F.col("start_idx"))).alias("later_start_idx"),
    )
    return out.select(
        "*",
        (F.col("earlier_end_sclk") < F.col("later_start_sclk")).alias("in_order"),
        (F.col("earlier_end_idx") >= F.col("later_start_idx")).alias("index_overlap"),
    )


def missing_by_class(df: DataFrame, features: list[str], label: str = "y") -> DataFrame:
    """Share of nulls per class and feature, with the separation verdict and the >50-point rule."""
    v, y = F.col("value").isNull(), F.col(label)
    per = long_features(df, features, label).groupBy("feature").agg(
        F.sum((v & (y == 1)).cast("long")).alias("pos_missing"), F.sum((y == 1).cast("long")).alias("_p"),
        F.sum((v & (y == 0)).cast("long")).alias("neg_missing"), F.sum((y == 0).cast("long")).alias("_n"),
    )
    pp, np_ = ratio(F.col("pos_missing") * 100.0, F.col("_p")), ratio(F.col("neg_missing") * 100.0, F.col("_n"))
    verdict = (
        F.when((F.col("pos_missing") == F.col("_p")) & (F.col("neg_missing") == 0), "PERFECT_SEPARATION")
        .when((pp > 90) & (np_ < 10), "STRONG_SEPARATION")
        .otherwise("NO_LEAKAGE")
    )
    return per.select(
        "feature", pp.alias("pos_missing_pct"), np_.alias("neg_missing_pct"), verdict.alias("verdict"),
        (F.abs(pp - np_) > 50).alias("systematic"),
    )


def leakage_scan(df: DataFrame, features: list[str], label: str = "y", limit: float = 0.99) -> DataFrame:
    """Findings: suspicious names, near-perfect label correlation, constants, equal columns.

    Two columns can only be equal on every row if their extremes agree, so the first pass (one
    row per feature) leaves few pairs for the second.
    """
    v, y = F.col("value"), F.col(label).cast("double")
    per = long_features(df, features, label).groupBy("feature").agg(
        safe_corr(v, y).alias("r"), F.min(v).alias("lo"), F.max(v).alias("hi")
    )
    stats = {x["feature"]: x for x in per.collect()}
    found = [("suspicious_name", f, 1.0) for f in features if any(k in f.lower() for k in SUSPICIOUS)]
    for f in features:
        s = stats[f]
        if s["r"] is not None and abs(s["r"]) > limit:
            found.append(("label_correlation", f, abs(s["r"])))
        if s["lo"] is None or s["lo"] == s["hi"]:
            found.append(("constant", f, 0.0))

    def near(a, b) -> bool:
        return a is not None and b is not None and abs(a - b) <= 1e-8 + 1e-10 * abs(b)

    pairs = [
        (a, b) for a, b in combinations(features, 2) if near(stats[a]["lo"], stats[b]["lo"]) and near(stats[a]["hi"], stats[b]["hi"])
    ]
    findings = df.sparkSession.createDataFrame(found, "kind string, subject string, value double")
    if not pairs:
        return findings
    gaps = [F.max(F.abs(F.col(a) - F.col(b)) - F.lit(1e-10) * F.abs(b)).alias(f"_d_{i}") for i, (a, b) in enumerate(pairs)]
    equal = [
        F.when(F.col(f"_d_{i}") <= 1e-8, F.struct(F.lit("equal_columns").alias("kind"), F.lit(f"{a}~{b}").alias("subject"), F.lit(0.0).alias("value")))
        for i, (a, b) in enumerate(pairs)
    ]
    return findings.unionByName(df.agg(*gaps).select(F.inline(F.array_compact(F.array(*equal)))))


def training_quality(df: DataFrame, features: list[str], label: str = "y", small: int = 500) -> DataFrame:
    """Size, duplicate feature rows, features of no variance, and the widest class separation."""
    y = F.col(label)
    distinct = df.select(*features).distinct().agg(F.count(F.lit(1)).alias("_distinct"))
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        sum((F.coalesce(F.var_pop(f) < 1e-10, F.lit(False)).cast("int") for f in features), F.lit(0)).alias("flat_features"),
        *[F.abs(F.avg(F.when(y == 1, F.col(f))) - F.avg(F.when(y == 0, F.col(f)))).alias(f"_s_{f}") for f in features],
    )
    cells = F.array(*[F.struct(F.col(f"_s_{f}").alias("v"), F.lit(f).alias("f")) for f in features])
    return attach(row, distinct).select(
        "n_rows", (F.col("n_rows") < small).alias("is_small"), (F.col("n_rows") - F.col("_distinct")).alias("duplicate_rows"),
        "flat_features", F.array_max(cells).getField("f").alias("widest_feature"),
        F.array_max(cells).getField("v").alias("widest_separation"),
    )


def duplicate_pair(df: DataFrame, a: str = "pressure_drop", b: str = "range") -> DataFrame:
    """Whether two features are the same column, or nearly so."""
    gap = F.abs(F.col(a) - F.col(b)) - F.lit(1e-5) * F.abs(b)
    row = df.agg(F.max(gap).alias("_d"), safe_corr(F.col(a), F.col(b)).alias("r"), F.sum((F.col(a) == F.col(b)).cast("long")).alias("equal_rows"))
    kind = F.when(F.col("_d") <= 1e-8, "IDENTICAL").when(F.col("r") > 0.95, "HIGHLY_CORRELATED").otherwise("DISTINCT")
    return row.select(kind.alias("verdict"), "r", "equal_rows")


def stats_consistency(split_rows: DataFrame, window_rows: DataFrame, window_features: DataFrame) -> DataFrame:
    """Spread of global statistics and of key features across splits, with the verdict and its reasons."""

    def spread(rows: DataFrame, tag: str) -> DataFrame:
        per = rows.groupBy("split").agg(F.avg("pressure").alias("m"), F.stddev_samp("pressure").alias("s"))
        return per.agg(
            (F.max("m") - F.min("m")).alias(f"{tag}_mean_spread"), (F.max("s") - F.min("s")).alias(f"{tag}_std_spread")
        )

    per = window_features.groupBy("split").agg(*[F.avg(f).alias(f"m_{f}") for f in KEY_FEATURES], *[F.stddev_samp(f).alias(f"s_{f}") for f in KEY_FEATURES])
    aggs = []
    for f in KEY_FEATURES:
        m, s = F.col(f"m_{f}"), F.col(f"s_{f}")
        wide = ((F.max(m) - F.min(m)) > 0.1 * F.abs(F.avg(m))) | ((F.max(s) - F.min(s)) > 0.1 * F.abs(F.avg(s)))
        aggs.append(wide.alias(f"{f}_differs"))
    z = F.col("m_min_zscore")
    feats = per.agg(*aggs, (F.max(z) - F.min(z)).alias("zscore_spread"))
    row = attach(spread(window_rows, "window"), spread(split_rows, "split"), feats)
    c = F.col
    reasons = F.array_compact(
        F.array(
            F.when((c("window_mean_spread") > 1.0) | (c("window_std_spread") > 1.0), F.lit("window statistics vary")),
            F.when(c("zscore_spread") > 0.5, F.lit("min_zscore varies")),
            F.when(c("split_mean_spread") < c("window_mean_spread"), F.lit("split statistics are steadier")),
        )
    )
    return row.select("*", (F.size(reasons) > 0).alias("needs_fix"), F.concat_ws("; ", reasons).alias("reasons"))


def score_behaviour(train: DataFrame, train_auc: DataFrame, val_auc: DataFrame, score: str = "p", label: str = "y") -> DataFrame:
    """Distinct scores of the positives and the fall of ROC AUC from training to validation."""
    pos = train.filter(F.col(label) == 1).agg(F.countDistinct(score).alias("distinct_positive_scores"))
    a = train_auc.select(F.col("roc_auc").alias("train_auc"))
    b = val_auc.select(F.col("roc_auc").alias("val_auc"))
    out = attach(pos, a, b)
    return out.select(
        "*",
        (F.col("distinct_positive_scores") <= 3).alias("few_scores"),
        ((F.col("train_auc") - F.col("val_auc")) > 0.2).alias("overfit"),
    )


def label_relation(df: DataFrame, columns: list[str], label: str = "y", limit: float = 0.9) -> DataFrame:
    """Correlation of columns with the label, class means and deviations, and the high-correlation flag."""
    v, y = F.col("value"), F.col(label).cast("double")
    one, zero = F.when(y == 1, v), F.when(y == 0, v)
    return (
        long_features(df, columns, label)
        .groupBy("feature")
        .agg(
            safe_corr(v, y).alias("r"), F.avg(one).alias("mean_1"), F.stddev_samp(one).alias("std_1"),
            F.avg(zero).alias("mean_0"), F.stddev_samp(zero).alias("std_0"),
        )
        .withColumn("separation", F.abs(F.col("mean_1") - F.col("mean_0")))
        .withColumn("too_close", F.abs("r") > limit)
    )
