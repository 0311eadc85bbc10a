from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import index as ix


def test_dense_index_with_one_hot_clock(spark):
    """A third of the rows share one clock; the tie breaker keeps the index exact and the parts even."""
    rng = random.Random(1)
    rows = [(500 if i % 3 == 0 else rng.randrange(1000), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "sclk long, id long").repartition(7)
    got = {r["id"]: r["idx"] for r in ix.dense_index(df, "sclk", "id", partitions=6).collect()}
    want = {i: k for k, (_, i) in enumerate(sorted(rows))}
    assert got == want
    sizes = [r["n"] for r in ix.ordered_parts(df, "sclk", "id", partitions=6).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * 3000 / 6


@pytest.mark.parametrize("parts", [1, 8])
def test_index_does_not_depend_on_layout(spark, parts):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("sclk"), "id").repartition(parts)
    rows = ix.dense_index(df, "sclk", "id").collect()
    assert all(r["idx"] == r["sclk"] for r in rows)


def test_halo_gives_every_row_its_frame(spark):
    df = spark.range(100).select(F.col("id").alias("idx"), (F.col("id") * F.col("id")).cast("double").alias("v"))
    out = ix.rolling(
        df, {"s": F.sum("v").over(ix.trailing(30)), "c": F.sum("v").over(ix.centred(5))}, before=29, after=5, chunk=7
    ).collect()
    v = np.arange(100.0) ** 2
    assert len(out) == 100
    for r in out:
        i = r["idx"]
        assert r["s"] == v[max(0, i - 29) : i + 1].sum()
        assert r["c"] == v[max(0, i - 5) : i + 6].sum()


def test_prefix_frames_and_extremes(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(745, 0.03, 300)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "idx long, v double")
    got = {r["idx"]: r["m"] for r in ix.rolling_mean(df, "v", 100, "m", chunk=16).collect()}
    for i in range(300):
        assert got[i] == pytest.approx(v[max(0, i - 99) : i + 1].mean(), abs=1e-11)
    near = ix.halo(df, 29, chunk=40)
    helper, low = ix.extreme(F.min, "v", 30)
    prefix = ix.Prefix("v", squares=True)
    near = prefix.prepare(near.withColumn("v", F.col("v") - 745)).select("*", helper)
    out = ix.drop_halo(near.select("idx", "_own", "_chunk", low.alias("low"), prefix.std(30).alias("sd"))).collect()
    for r in out:
        if r["idx"] >= 29:
            w = v[r["idx"] - 29 : r["idx"] + 1] - 745
            assert r["low"] == pytest.approx(w.min(), abs=1e-12)
            assert r["sd"] == pytest.approx(w.std(), rel=1e-8)


def test_fill_and_running_sums_cross_chunks(spark):
    marks = {3: 1.0, 40: 2.0, 41: 3.0}
    df = spark.createDataFrame([(i, marks.get(i)) for i in range(90)], "idx long, x double")
    out = ix.fill_forward(ix.running_sums(df, {"n": F.col("x").isNotNull().cast("long")}, chunk=8), ["x"], chunk=8)
    for r in out.collect():
        seen = [k for k in marks if k <= r["idx"]]
        assert r["x_ffill"] == (marks[max(seen)] if seen else None)
        assert r["n"] == len(seen)


def test_renumber_subset(spark):
    df = spark.range(500).filter("id % 7 = 3").select(F.col("id").alias("idx")).repartition(5)
    rows = sorted((r["idx"], r["k"]) for r in ix.renumber(df, "k", chunk=16).collect())
    assert [k for _, k in rows] == list(range(len(rows)))


def test_percentiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.exponential(1, 400), 2), np.round(rng.exponential(3, 33), 1)
    df = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b], "g string, v double")
    qs = [0.0, 0.1, 0.5, 0.95, 0.999, 1.0]
    for r in ix.exact_percentiles(df, "v", qs, by="g").collect():
        assert r["v"] == pytest.approx(np.percentile(a if r["g"] == "a" else b, r["q"] * 100), abs=1e-12)
    assert ix.exact_percentiles(df.filter("g = 'none'"), "v", [0.5]).count() == 0
