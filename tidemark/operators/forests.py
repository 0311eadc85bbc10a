"""A fitted forest as arrays, and its answers when single features of a row are replaced.

A forest tests a feature only against the thresholds of its own splits, so a value is known well enough by the
number of thresholds below it. A row's path through a tree is walked once; every leaf keeps the range
of each feature that leads to it, and a replaced value inside that range ends in the same leaf. Only the others
walk the tree again. Votes are added tree by tree, as the fitted model adds them, so its predictions are met exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import new_table

#: Cells of the table of replaced rows that a task works on at a time; small enough for a core's own cache.
CELLS = 1 << 20
#: Rows that a task asks about at a time.
BLOCK = 1 << 14


@dataclass
class Tree:
    """Nodes by level, the right child next to the left. ``word`` holds feature, place of the threshold and left child; a leaf leads to itself."""

    word: np.ndarray
    share: np.ndarray
    levels: list[int]

    @staticmethod
    def of(left: np.ndarray, right: np.ndarray, feature: np.ndarray, cut: np.ndarray, share: np.ndarray) -> Tree:
        level, order, levels = np.zeros(1, np.int64), [], [0]
        while len(level):
            order.append(level)
            levels.append(levels[-1] + len(level))
            inner = level[left[level] >= 0]
            level = np.stack([left[inner], right[inner]], axis=1).ravel()
        at = np.concatenate(order)
        place = np.empty(len(left), np.int64)
        place[at] = np.arange(len(at))
        leaf = left[at] < 0
        below = np.where(leaf, place[at], place[np.where(leaf, at, left[at])])
        word = np.where(leaf, 0, feature[at]) | np.where(leaf, 0xFFFF, cut[at]) << 16 | below << 32
        return Tree(word, share[at], levels)

    def ranges(self, width: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest place of every feature on the way to each node."""
        low = np.zeros((len(self.word), width), kind)
        high = np.full((len(self.word), width), np.iinfo(kind).max, kind)
        for a, b in zip(self.levels, self.levels[1:]):
            at = np.arange(a, b)
            at = at[self.word[at] >> 32 != at]
            f, cut, left = self.word[at] & 0xFFFF, (self.word[at] >> 16 & 0xFFFF).astype(kind), self.word[at] >> 32
            for side in (left, left + 1):
                low[side], high[side] = low[at], high[at]
            high[left, f] = np.minimum(high[left, f], cut)
            low[left + 1, f] = np.maximum(low[left + 1, f], cut + 1)
        return low, high

    def leaves(self, places: np.ndarray, width: int, rows: np.ndarray) -> np.ndarray:
        """Leaf of each of ``rows`` of a flat table of places."""
        out = np.zeros(len(rows), np.int64)
        alive, base, at = None, rows * width, out
        for step in range(1, len(self.levels) - 1):
            w = self.word[at]
            at = (w >> 32) + (places[base + (w & 0xFFFF)] > (w >> 16 & 0xFFFF))
            if step % 4 == 0:  # rows that have come to a leaf stay behind
                on = np.flatnonzero(self.word[at] >> 32 != at)
                if len(on) < 0.8 * len(at):
                    if alive is None:
                        out, alive = at, on
                    else:
                        out[alive] = at
                        alive = alive[on]
                    base, at = base[on], at[on]
        if alive is None:
            return at
        out[alive] = at
        return out


@dataclass
class Forest:
    features: list[str]
    #: Distinct thresholds of each feature, in order.
    thresholds: list[np.ndarray]
    trees: list[Tree]

    @staticmethod
    def of(model: RandomForestClassificationModel | ForestModel, features: list[str], spark: SparkSession) -> Forest:
        """From the model's stored form, unless it holds the arrays. Its size is that of the model, which the driver holds anyway."""
        if isinstance(model, ForestModel):
            return model.forest
        path = new_table(spark)
        model.write().save(path)
        node = lambda c: F.col(f"nodeData.{c}").alias(c.split(".")[-1])
        test = F.col("nodeData.split.leftCategoriesOrThreshold")
        t = spark.read.parquet(f"{path}/data").select(
            "treeID", node("id"), node("leftChild"), node("rightChild"), node("split.featureIndex"), node("split.numCategories"), F.get(test, F.lit(0)).alias("threshold"), node("impurityStats")
        )
        t = t.toArrow()
        get = lambda c: t.column(c).to_numpy()
        tree, feature, left = get("treeID"), get("featureIndex"), get("leftChild")
        if ((left >= 0) & (get("numCategories") >= 0)).any():
            raise ValueError("splits by category are not supported")
        threshold = np.where(left >= 0, get("threshold").astype(float), np.nan)
        counts = np.array(t.column("impurityStats").combine_chunks().flatten()).reshape(len(left), -1)
        total = counts.cumsum(axis=1)[:, -1:]  # added in the order of classes
        share = np.divide(counts, total, out=np.zeros_like(counts), where=total != 0)
        thresholds = [np.unique(threshold[(feature == j) & (left >= 0)]) for j in range(len(features))]
        cut = np.zeros(len(left), np.int64)
        for j, values in enumerate(thresholds):
            mine = (feature == j) & (left >= 0)
            cut[mine] = np.searchsorted(values, threshold[mine])
        order = np.lexsort((get("id"), tree))
        parts = np.split(order, np.flatnonzero(np.diff(tree[order])) + 1)
        columns = [c.astype(np.int64) for c in (left, get("rightChild"), feature, cut)]
        return Forest(features, thresholds, [Tree.of(*(c[p] for c in columns), share[p]) for p in parts])

    def places(self, x: np.ndarray) -> np.ndarray:
        """Number of thresholds below each value; a missing value lies above all."""
        kind = np.uint8 if max(map(len, self.thresholds)) < 255 else np.uint16
        return np.stack([np.searchsorted(v, x[..., j]) for j, v in enumerate(self.thresholds)], axis=-1).astype(kind)

    def votes(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' class shares for each row."""
        width, rows = len(self.features), np.arange(len(x))
        places, out = self.places(x).ravel(), np.zeros((len(x), self.trees[0].share.shape[1]))
        for tree in self.trees:
            out += tree.share[tree.leaves(places, width, rows)]
        return out

    def replaced(self, own: np.ndarray, donors: np.ndarray, ranges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Predicted class of each row of ``own`` (rows by features), and, by donor, row and feature, with that feature's value from the donor."""
        width = len(self.features)
        x, d = self.places(own), self.places(donors)
        mixed = np.broadcast_to(x[None, :, None, :], (*d.shape, width)).copy()
        every = np.arange(width)
        mixed[:, :, every, every] = d
        x, mixed = x.ravel(), mixed.ravel()
        rows = np.arange(len(own))
        classes = self.trees[0].share.shape[1]
        base, votes = np.zeros((len(own), classes)), np.zeros((*d.shape, classes))
        step = np.empty_like(votes)
        for k, tree in enumerate(self.trees):
            low, high = ranges[k] if ranges else tree.ranges(width, d.dtype.type)
            leaf = tree.leaves(x, width, rows)
            share = tree.share[leaf]
            base += share
            step[:] = share[:, None, :]
            again = np.flatnonzero((d < low[leaf]) | (d > high[leaf]))
            step.reshape(-1, classes)[again] = tree.share[tree.leaves(mixed, width, again)]
            votes += step
        return base.argmax(axis=-1), votes.argmax(axis=-1)

    def count_hits(self, df: DataFrame, own: str, donors: list[str], label: str) -> DataFrame:
        """Rows and right predictions by ``repeat`` and replaced feature ``_j`` (-1: none). ``own`` and ``donors`` are array columns; rows without a label do not count."""
        forest, width = self, len(self.features)
        block = max(1, CELLS // (max(1, len(donors)) * width * width))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = np.uint8 if max(map(len, forest.thresholds)) < 255 else np.uint16
            ranges = [t.ranges(width, kind) for t in forest.trees]
            seen, n, base, hits = False, 0, 0, np.zeros((len(donors), width), np.int64)
            for b in batches:
                table = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
                x, d = table(own), np.stack([table(c) for c in donors])
                y, known = b.column(label).to_numpy(zero_copy_only=False).astype(float), b.column(label).is_valid().to_numpy(zero_copy_only=False)
                seen = seen or len(y) > 0
                for a in range(0, len(y), block):
                    plain, tried = forest.replaced(x[a : a + block], d[:, a : a + block], ranges)
                    n += int(known[a : a + block].sum())
                    base += int((plain == y[a : a + block]).sum())
                    hits += (tried == y[None, a : a + block, None]).sum(axis=1)
            if seen:
                r, j = (v.ravel() for v in np.indices(hits.shape))
                repeat, tried = np.concatenate([np.arange(len(donors)), r]), np.concatenate([np.full(len(donors), -1), j])
                right = np.concatenate([np.full(len(donors), base), hits.ravel()])
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (repeat, tried, np.full(len(right), n), right)], names=["repeat", "_j", "n", "hits"])

        counted = df.select(own, *donors, label).mapInArrow(run, "repeat long, _j long, n long, hits long")
        return counted.groupBy("repeat", "_j").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


class ForestModel(Model):
    """A forest as the last stage of a pipeline: adds ``rawPrediction``, ``probability`` and ``prediction`` to rows with a vector ``features``."""

    def __init__(self, forest: Forest, importances: np.ndarray) -> None:
        super().__init__()
        self.forest = forest
        #: Each feature's part in the fall of impurity, averaged over trees; they add up to 1.
        self.featureImportances: DenseVector = Vectors.dense(importances)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest, width = self.forest, len(self.forest.features)

        @F.arrow_udf("array<double>")
        def votes(x: pa.Array) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            blocks = [forest.votes(rows[a : a + BLOCK]) for a in range(0, len(rows), BLOCK)] or [np.zeros((0, 2))]
            out = np.concatenate(blocks)
            return pa.ListArray.from_arrays(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32), out.ravel())

        raw = F.col("_raw")
        whole = F.aggregate(raw, F.lit(0.0), lambda s, v: s + v)
        first = F.array_position(raw, F.array_max(raw)) - 1
        out = dataset.withColumn("_raw", votes(vector_to_array("features")))
        return out.withColumns(
            {"rawPrediction": array_to_vector(raw), "probability": array_to_vector(F.transform(raw, lambda v: v / whole)), "prediction": first.cast("double")}
        ).drop("_raw")
