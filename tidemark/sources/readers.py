"""Scans: typed CSV and Parquet, clean and validated loads, fallbacks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import as_flag

FLAGS = ("gt_fwhm", "gt_detection_win", "gt_4xfwhm")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema; columns are checked by name and empty cells are null."""
    return spark.read.csv(path, schema=schema, header=True, enforceSchema=False)


def read_first_available(spark: SparkSession, paths: list[str], fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """The first path that can be read."""
    missing: Exception | None = None
    for path in paths:
        try:
            reader = spark.read.format(fmt)
            if schema is not None:
                reader = reader.schema(schema)
            if fmt == "csv":
                reader = reader.option("header", True)
            return reader.load(path)
        except AnalysisException as e:
            missing = e
    raise FileNotFoundError(f"none of {paths} can be read") from missing


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def validated(df: DataFrame, required: list[str] = ("SCLK", "PRESSURE", "gt_detection_win", "gt_fwhm")) -> DataFrame:
    """Check columns, fail on an empty source, and make the flags boolean."""
    require_columns(df, list(required))
    if df.isEmpty():
        raise ValueError("source is empty")
    present = [f for f in FLAGS if f in df.columns]
    return df.withColumns({f: as_flag(F.col(f)) for f in present})


def coerce_clock(df: DataFrame, clock: str = "SCLK") -> DataFrame:
    """Clock as BIGINT; text that is no number becomes null. Decimal text is cut to whole seconds."""
    return df.withColumn(clock, F.floor(F.col(clock).try_cast("double")).cast("long"))


def clean(df: DataFrame, clock: str = "SCLK") -> DataFrame:
    """Rows with a usable clock. Order is not imposed here: the index sorts once."""
    return coerce_clock(df, clock).filter(F.col(clock).isNotNull())


def clean_report(df: DataFrame, clock: str = "SCLK") -> DataFrame:
    """How many rows a clean load keeps and drops, in one pass."""
    bad = coerce_clock(df, clock).select(F.col(clock).isNull().cast("long").alias("_bad"))
    return bad.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.coalesce(F.sum("_bad"), F.lit(0).cast("long")).alias("dropped_rows"),
        (F.count(F.lit(1)) - F.coalesce(F.sum("_bad"), F.lit(0))).cast("long").alias("kept_rows"),
    )


def select_features(df: DataFrame, train_columns: list[str], exclude: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Keep the training features that exist, in training order; also return the missing ones."""
    wanted = [c for c in train_columns if c not in exclude]
    return df.select([c for c in wanted if c in df.columns]), [c for c in wanted if c not in df.columns]
