"""Appends to an index and its features equal a rebuild, and read only what they must."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators.index import rolling_mean
from tidemark.sources.growing import GrowingFeatures, GrowingIndex


def frame(spark, rows):
    return spark.createDataFrame(rows, "t long, id long, pressure double").repartition(3)


def test_appends_equal_a_rebuild_and_leave_old_parts_alone(spark):
    r = random.Random(1)
    rows = [(i // 2, i, round(r.gauss(700, 3), 2)) for i in range(1000)]
    root = tempfile.mkdtemp(prefix="growing-")
    index = GrowingIndex(spark, root + "/index", "t", "id")
    mean = lambda df: rolling_mean(df.select("idx", "pressure"), "pressure", 50, "m", chunk=64)
    cache = GrowingFeatures(index, root + "/features", mean, before=49)
    late = rows[880:900]  # come with the last append and lie before part of the one before
    steps = [rows[:600], rows[600:880], rows[900:950], [*late, *rows[950:]]]
    starts = [0, 600, 880, 880]
    have = []
    for step, start in zip(steps, starts):
        before = index.parts.rows()
        changed = index.append(frame(spark, step))
        have = sorted([*have, *step])
        assert changed == start and len(index) == len(have)
        got = [(x.idx, x.t, x.id, x.pressure) for x in index.read().orderBy("idx").collect()]
        assert got == [(k, *row) for k, row in enumerate(have)]
        # Parts before the change are the same files.
        kept = [p["part"] for p in before if p["first"] + p["n"] <= changed]
        assert [p["part"] for p in index.parts.rows()][: len(kept)] == kept
        if len(have) > len(step):
            with pytest.raises(ValueError):
                cache.read()
        assert cache.update(changed) == changed
        want = {x.idx: x.m for x in mean(index.read()).collect()}
        assert {x.idx: x.m for x in cache.read().collect()} == pytest.approx(want)
        assert cache.parts.read(cache.parts.rows()[-1]["part"]).count() == len(have) - changed
    assert index.append(frame(spark, rows[:0])) == 1000 and index.parts.version() == 4
    assert index.parts.clean() == 1 and len(index.parts._names("versions")) == 1
    assert index.read().count() == 1000
    plan = index.read().filter(F.col("idx") >= 990)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(idx,990)" in plan
