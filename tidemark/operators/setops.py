"""Set operations over streams and schemas, and the report that compares two data sets."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.functions.scalars import ratio


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def shared_clocks(a: DataFrame, b: DataFrame, clock: str = "sclk") -> DataFrame:
    return a.select(clock).intersect(b.select(clock))


def split_overlaps(split_stream: DataFrame, splits=("train", "val", "test"), clock: str = "sclk") -> DataFrame:
    """Number of clock values that two splits share, for every pair of splits.

    One pass: the splits of each clock are gathered as flags (never a list of rows).
    """
    has = split_stream.groupBy(clock).agg(*[F.bool_or(F.col("split") == s).alias(s) for s in splits])
    pairs = list(combinations(splits, 2))
    row = has.agg(*[F.sum((F.col(a) & F.col(b)).cast("long")).alias(f"{a}_{b}") for a, b in pairs])
    cells = [F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs]
    return row.select(F.inline(F.array(*cells)))


def schema_diff(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Column names in both, only in the first, only in the second (metadata, no job)."""
    x, y = set(a.columns), set(b.columns)
    return {"common": sorted(x & y), "only_left": sorted(x - y), "only_right": sorted(y - x)}


def compare_datasets(a: DataFrame, b: DataFrame, flag: str = "gt_detection_win", clock: str = "sclk") -> DataFrame:
    """Long report ``metric, left_value, right_value`` with sizes, ranges, flag rates and overlap."""
    names = ["rows", "columns", "min_clock", "max_clock", "sols", "positives", "positive_rate", "mean_pressure", "std_pressure"]

    def one(df: DataFrame) -> DataFrame:
        pos = F.sum(F.col(flag).cast("long"))
        return df.agg(
            F.count(F.lit(1)).cast("double").alias("rows"), F.lit(float(len(df.columns))).alias("columns"),
            F.min(clock).cast("double").alias("min_clock"), F.max(clock).cast("double").alias("max_clock"),
            (F.max("sol") - F.min("sol")).cast("double").alias("sols"), pos.cast("double").alias("positives"),
            ratio(pos, F.count(F.lit(1))).alias("positive_rate"), F.avg("pressure").alias("mean_pressure"),
            F.stddev_samp("pressure").alias("std_pressure"),
        )

    right = one(b)
    right = right.select([F.col(n).alias(f"_r_{n}") for n in names])
    cells = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("left_value"), F.col(f"_r_{n}").alias("right_value")) for n in names]
    base = attach(one(a), right).select(F.inline(F.array(*cells)))
    left_clocks = a.select(clock).distinct().withColumn("_l", F.lit(1))
    right_clocks = b.select(clock).distinct().withColumn("_r", F.lit(1))
    both = left_clocks.join(right_clocks, clock, "full").agg(
        F.sum((F.col("_l").isNotNull() & F.col("_r").isNotNull()).cast("double")).alias("shared"),
        F.sum(F.col("_r").isNull().cast("double")).alias("only_l"),
        F.sum(F.col("_l").isNull().cast("double")).alias("only_r"),
    )
    over = both.select(
        F.inline(
            F.array(
                F.struct(F.lit("shared_clocks").alias("metric"), F.col("shared").alias("left_value"), F.col("shared").alias("right_value")),
                F.struct(F.lit("own_clocks").alias("metric"), F.col("only_l").alias("left_value"), F.col("only_r").alias("right_value")),
            )
        )
    )
    return base.unionByName(over)
