"""Intermediate tables in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import new_table


class Table:
    """A frame written once as Parquet in the running scratch scope; ``df`` scans it. A lost executor costs no part of it."""

    def __init__(self, df: DataFrame):
        spark = df.sparkSession
        self.path = new_table(spark)
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, when no later plan reads them."""
        remove(self.df.sparkSession, self.path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores before it, such that no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
