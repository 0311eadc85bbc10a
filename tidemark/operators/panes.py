"""Aggregates of sliding windows from pane summaries, for any aggregate that can be merged.

Samples are reduced once to panes of gcd(step, size) rows. A window is a run of panes, and its value is
the merge of their states, in order. Minima, first values or "any" cannot be subtracted again, so runs
are built by doubling: states of 2, 4, 8, … panes that end at each pane, each from two of the length
before; a window of n panes joins those that n is the sum of. That is a logarithmic number of merges per
pane, whatever the aggregate, and no sample is copied.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.index import CHUNK, chunk_of, drop_halo, halo, in_chunk


@dataclass(frozen=True)
class Merged:
    """``pane``: aggregate that gives a pane's state; ``join``: state of an earlier and a later run; ``value``: what a state stands for."""

    pane: Column
    join: Callable[[Column, Column], Column]
    value: Callable[[Column], Column] = lambda state: state


def _sum(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def count(column: Column | None = None) -> Merged:
    """Rows, or values that are not null."""
    return Merged(F.count(F.lit(1) if column is None else column), lambda a, b: a + b)


def total(column: Column) -> Merged:
    return Merged(F.sum(column), _sum)


def low(column: Column) -> Merged:
    return Merged(F.min(column), F.least)


def high(column: Column) -> Merged:
    """Also whether any flag is set, for booleans."""
    return Merged(F.max(column), F.greatest)


def first(column: Column) -> Merged:
    return Merged(F.struct(F.min_by(column, "idx").alias("v")), lambda a, b: a, lambda s: s["v"])


def last(column: Column) -> Merged:
    return Merged(F.struct(F.max_by(column, "idx").alias("v")), lambda a, b: b, lambda s: s["v"])


def place_of_low(column: Column) -> Merged:
    """Position of the smallest value, the first one among equals."""
    return Merged(F.min(F.when(column.isNotNull(), F.struct(column.alias("v"), F.col("idx").alias("i")))), F.least, lambda s: s["i"])


def _moments(column: Column) -> tuple[Column, Callable[[Column, Column], Column]]:
    v = column.cast("double")
    n = F.count(v).cast("double")
    state = F.struct(n.alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias("m2"))

    def join(a: Column, b: Column) -> Column:
        both, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = F.coalesce(F.try_divide(b["n"], both), F.lit(0.0))
        return F.struct(both.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    return state, join


def mean(column: Column) -> Merged:
    return Merged(*_moments(column), lambda s: F.when(s["n"] > 0, s["mean"]))


def sample_std(column: Column) -> Merged:
    return Merged(*_moments(column), lambda s: F.when(s["n"] > 1, F.sqrt(s["m2"] / (s["n"] - 1))))


def window_summary(stream: DataFrame, size: int, step: int, aggregates: dict[str, Merged], chunk: int = CHUNK) -> DataFrame:
    """``window_id``, start_idx, end_idx and the aggregates of every full window of a stream that is dense from 0."""
    width = gcd(size, step)
    n = size // width
    panes = stream.groupBy(chunk_of("idx", width).alias("pane")).agg(F.count(F.lit(1)).alias("_rows"), *[a.pane.alias(f"_s_{k}") for k, a in aggregates.items()])
    near = halo(panes, n - 1, chunk=max(n, chunk // width), by="pane")
    w, done, length = in_chunk("pane"), 0, 1
    fixed = ["pane", "_rows", "_own", "_chunk"]
    while True:
        if n & length:
            # The run of this length that ends before what is joined already.
            earlier = {k: F.lag(f"_s_{k}", done).over(w) if done else F.col(f"_s_{k}") for k in aggregates}
            joined = {k: a.join(earlier[k], F.col(f"_w_{k}")) if done else earlier[k] for k, a in aggregates.items()}
            near = near.select(*fixed, *[F.col(f"_s_{k}") for k in aggregates], *[c.alias(f"_w_{k}") for k, c in joined.items()])
            done += length
        if done == n:
            break
        held = [F.col(f"_w_{k}") for k in aggregates] if done else []
        near = near.select(*fixed, *[a.join(F.lag(f"_s_{k}", length).over(w), F.col(f"_s_{k}")).alias(f"_s_{k}") for k, a in aggregates.items()], *held)
        length *= 2
    start = (F.col("pane") + 1) * width - size
    # Only the last pane can be short, and a window that ends there is not full.
    out = drop_halo(near).filter((F.col("_rows") == width) & (start >= 0) & (start % step == 0))
    return out.select((start / step).cast("long").alias("window_id"), start.alias("start_idx"), (start + size - 1).alias("end_idx"), *[a.value(F.col(f"_w_{k}")).alias(k) for k, a in aggregates.items()])
