"""Array expressions over one window of samples (built-in higher-order functions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def moments(a: Column) -> Column:
    """Mean and population deviation in one fold, as a struct.

    Sums are taken about the first element: exact for a flat window, and close to the data
    whatever its level.
    """
    first, n = F.element_at(a, 1), F.size(a)
    start = F.struct(F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))

    def add(s, x):
        d = x - first
        return F.struct((s["s1"] + d).alias("s1"), (s["s2"] + d * d).alias("s2"))

    def finish(s):
        m = s["s1"] / n
        return F.struct((first + m).alias("mean"), F.sqrt(F.greatest(s["s2"] / n - m * m, F.lit(0.0))).alias("std"))

    return F.aggregate(a, start, add, finish)


def array_diff(a: Column) -> Column:
    n = F.size(a)
    return F.zip_with(F.slice(a, 2, n - 1), F.slice(a, 1, n - 1), lambda y, x: y - x)


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return (F.element_at(s, ((n + 1) / 2).cast("int")) + F.element_at(s, (n / 2 + 1).cast("int"))) / 2


def array_gradient(a: Column) -> Column:
    """Centred differences inside, one-sided at both ends."""
    n = F.size(a)
    inner = F.zip_with(F.slice(a, 3, n - 2), F.slice(a, 1, n - 2), lambda y, x: (y - x) / 2)
    first = F.element_at(a, 2) - F.element_at(a, 1)
    last = F.element_at(a, -1) - F.element_at(a, -2)
    return F.concat(F.array(first), inner, F.array(last))


def peak_count(a: Column, height: Column, valleys: bool = False) -> Column:
    """Local maxima at or above ``height`` (or minima at or below it); borders never count.

    A flat top counts once. The fold remembers the last value and whether the series was rising
    (falling) when it was reached.
    """
    start = F.struct(F.element_at(a, 1).alias("v"), F.lit(False).alias("rising"), F.lit(0).cast("int").alias("n"))

    def fold(s, x):
        up, down, beyond = (
            (x < s["v"], x > s["v"], s["v"] <= height) if valleys else (x > s["v"], x < s["v"], s["v"] >= height)
        )
        return F.struct(
            x.alias("v"),
            (up | (s["rising"] & ~down)).alias("rising"),
            (s["n"] + F.when(down & s["rising"] & beyond, 1).otherwise(0)).cast("int").alias("n"),
        )

    return F.aggregate(F.slice(a, 2, F.size(a) - 1), start, fold, lambda s: s["n"])
