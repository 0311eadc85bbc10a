"""Bring the values of a one-row or few-row frame to every row, without a join.

Totals, bounds and statistics are read as scalar subqueries: each is run once, and its value is a
constant in the plan of the frame that uses it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that may travel as one array.
FEW = 10_000


def attach(df: DataFrame, *rows: DataFrame) -> DataFrame:
    """Add the columns of frames that have exactly one row (aggregates without grouping)."""
    for k, row in enumerate(rows):
        name = f"_row{k}"
        value = row.select(F.struct("*").alias("s")).scalar()
        df = df.withColumn(name, value).select(*df.columns, *[F.col(name)[c].alias(c) for c in row.columns])
    return df


def few(table: DataFrame) -> DataFrame:
    """A small table (classes, splits, picked thresholds) as one row with an array column ``_few``.

    A table of over ``FEW`` rows is not small: the query fails with a message and wants a join.
    """
    size = F.count(F.lit(1))
    guard = F.when(size > FEW, F.raise_error(F.lit(f"more than {FEW} rows are no small table; join them"))).otherwise(F.lit(True))
    rows = table.limit(FEW + 1).agg(F.collect_list(F.struct("*")).alias("_few"), guard.alias("_ok"))
    return rows.select(F.when(F.col("_ok"), F.col("_few")).alias("_few"))


def fan_out(df: DataFrame, table: DataFrame) -> DataFrame:
    """Every row once per row of a small table; the copies are made inside the task."""
    return attach(df, few(table)).select(*df.columns, F.inline("_few"))
