"""Sinks: CSV, split-partitioned tables, run records, and a feature cache that checks its length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_by_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, so that reading one split never opens the files of another."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def record_metrics(result: DataFrame, path: str, run_id: str, run_ts: int, kind: str, name: str = "model", threshold: str = "threshold") -> None:
    """Append metric columns as long run records."""
    skip = {name, threshold}
    metrics = [c for c, t in result.dtypes if c not in skip and t in ("double", "bigint", "int")]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    rows = result.select(
        F.lit(run_id).alias("run_id"), F.lit(run_ts).cast("long").alias("run_ts"), F.lit(kind).alias("kind"),
        (F.col(name) if name in result.columns else F.lit(None)).cast("string").alias("name"),
        (F.col(threshold) if threshold in result.columns else F.lit(None)).cast("double").alias("threshold"),
        F.inline(pairs),
    )
    rows.write.mode("append").parquet(path)


def latest_run(runs: DataFrame, kind: str | None = None) -> DataFrame:
    """Records of the newest run (per kind); among equal times the highest run id wins."""
    rows = runs if kind is None else runs.filter(F.col("kind") == kind)
    newest = rows.groupBy("kind").agg(F.max(F.struct("run_ts", "run_id")).alias("_n"))
    picked = newest.select("kind", F.col("_n.run_ts").alias("run_ts"), F.col("_n.run_id").alias("run_id"))
    return rows.join(picked, ["kind", "run_ts", "run_id"], "left_semi")


def best_recorded_threshold(runs: DataFrame, metric: str = "f1") -> DataFrame:
    """Per name, the threshold with the highest recorded metric (lowest threshold among equals)."""
    w = Window.partitionBy("name").orderBy(F.desc("value"), "threshold")
    rows = runs.filter(F.col("metric") == metric)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("name", "threshold", "value")


def cached_features(spark: SparkSession, path: str, expected_rows: int, build: Callable[[], DataFrame]) -> DataFrame:
    """Reuse a saved feature table if it has the expected length, else build and save it."""
    try:
        saved = spark.read.parquet(path)
        if saved.count() == expected_rows:
            return saved
    except AnalysisException:
        pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
