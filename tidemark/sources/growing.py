"""An index that grows by parts, and features that follow it.

A sorted part is written once. Rows that come later are sorted alone and put behind the others; only
parts that reach past the first of the new rows are sorted again with them, usually none or the last.
Which parts make up the index, their lengths and offsets stand in a small versioned table that is
written last, so a reader sees the state before or after an append, and a failed append leaves only
files that nobody reads (:meth:`GrowingIndex.clean` removes them). Features over neighbouring rows are
kept in the same way: after an append they are made again for the changed rows and those whose frames
reach them, from these rows and their halo.

One writer at a time; any number of readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.index import dense_index


class Parts:
    """Versioned list of parts below ``root``: one small table per version, the newest whole one counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *names: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def version(self) -> int:
        """Number of the newest version, 0 if there is none."""
        done = [int(n) for n in self._names("versions") if self._fs().exists(self._path("versions", n, "_SUCCESS"))]
        return max(done, default=0)

    def rows(self) -> list[Row]:
        v = self.version()
        return self.spark.read.parquet(f"{self.root}/versions/{v}").orderBy("first").collect() if v else []

    def commit(self, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/versions/{self.version() + 1}")

    def new(self, df: DataFrame) -> str:
        """Write a part; its name."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/parts/{name}")
        return name

    def read(self, *names: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/parts/{n}" for n in names])

    def clean(self) -> int:
        """Delete the files that the newest version does not use; how many parts went."""
        used = {r["part"] for r in self.rows()}
        gone = [n for n in self._names("parts") if n not in used]
        for n in gone:
            self._fs().delete(self._path("parts", n), True)
        for n in self._names("versions"):
            if int(n) < self.version():
                self._fs().delete(self._path("versions", n), True)
        return len(gone)


class GrowingIndex:
    """Rows with their dense position ``name`` in the order of ``keys``, which must be unique."""

    def __init__(self, spark: SparkSession, root: str, *keys: str, name: str = "idx"):
        self.parts, self.keys, self.name = Parts(spark, root), keys, name

    def append(self, rows: DataFrame) -> int:
        """Add rows; the first position that is new or has changed (the length, if there are none)."""
        key = F.struct(*self.keys)
        low = rows.agg(F.min(key)).first()[0]
        known = self.parts.rows()
        if low is None:
            return sum(r["n"] for r in known)
        kept = [r for r in known if tuple(r["high"]) < tuple(low)]
        again = [r["part"] for r in known[len(kept) :]]
        if again:
            rows = rows.unionByName(self.parts.read(*again).drop(self.name))
        start = sum(r["n"] for r in kept)
        part = self.parts.new(dense_index(rows, *self.keys, name=self.name).withColumn(self.name, F.col(self.name) + start))
        n, high = self.parts.read(part).agg(F.count(F.lit(1)), F.max(key)).first()
        kind = rows.select(key.alias("k")).schema["k"].dataType.simpleString()
        self.parts.commit([*[(r["part"], r["first"], r["n"], r["high"]) for r in kept], (part, start, n, high)], f"part string, first long, n long, high {kind}")
        return start

    def read(self) -> DataFrame:
        """All rows; a range of positions reads the parts that hold it."""
        return self.parts.read(*[r["part"] for r in self.parts.rows()])

    def __len__(self) -> int:
        return sum(r["n"] for r in self.parts.rows())


class GrowingFeatures:
    """Features of an index's rows by ``compute``, whose frames reach ``before`` rows back and ``after`` ahead."""

    def __init__(self, index: GrowingIndex, root: str, compute: Callable[[DataFrame], DataFrame], before: int, after: int = 0):
        self.index, self.parts, self.compute = index, Parts(index.parts.spark, root), compute
        self.before, self.after = before, after

    def update(self, changed: int) -> int:
        """Make the features from position ``changed`` on anew (the least that ``append`` has returned since); the first position made."""
        i, known = F.col(self.index.name), self.parts.rows()
        first = max(0, min([changed - self.after, *([known[-1]["end"]] if known else [0])]))
        near = self.index.read().filter(i >= first - self.before)
        part = self.parts.new(self.compute(near).filter(i >= first))
        kept = [(r["part"], r["first"], min(r["end"], first)) for r in known if r["first"] < first]
        self.parts.commit([*kept, (part, first, len(self.index))], "part string, first long, end long")
        return first

    def read(self) -> DataFrame:
        """Features of all rows, and an error if the index has grown since."""
        rows, i = self.parts.rows(), F.col(self.index.name)
        if not rows or rows[-1]["end"] != len(self.index):
            raise ValueError(f"features end at {rows[-1]['end'] if rows else 0}, the index at {len(self.index)}: call update")
        out = None
        for r in rows:
            part = self.parts.read(r["part"]).filter((i >= r["first"]) & (i < r["end"]))
            out = part if out is None else out.unionByName(part)
        return out
