"""A random forest of two classes grown on rows that are cut into bins once.

All trees grow together, one Spark job a level. Every row keeps, with its bins, how often each tree drew it and the
place of its node among the tree's open ones; tasks count drawn rows by node, drawn feature, bin and class, the counts of a tree
meet in one task, which picks its splits, and only these come to the driver. Trees go through a level in groups, so that
a task holds the counts of some ``NODES`` nodes. The rules are those of Spark's forest: a bootstrap by Poisson draws, as many
features drawn for a node as the root of their number, fall of the Gini impurity over class weights, least rows on either
side, leaves of one parent merged if they say the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame

from tidemark.operators.boosting import BINS, Binned
from tidemark.operators.forests import Forest, ForestModel, Tree
from tidemark.operators.ml import SEED

#: Nodes of a level whose counts a task holds at a time, and nodes whose splits are picked at a time.
NODES, SLICE = 1 << 17, 1 << 10


def _bag(trees: int, kind: type):
    """Block of :class:`Binned` → (bins, class, draws by tree, place of the row's open node by tree; -1: none)."""

    def run(block: tuple) -> tuple:
        place, bins, sign, _ = block
        drawn = np.stack([np.random.default_rng([SEED, t, *place]).poisson(1.0, len(sign)) for t in range(trees)])
        return bins, (sign > 0).astype(np.int8), np.minimum(drawn, 255).astype(np.uint8), np.where(drawn > 0, 0, -1).astype(kind)

    return run


def _move(steps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Rows go to their next node by (feature, bin, places of the two children) of each open node; the others leave the tree."""

    def run(block: tuple) -> tuple:
        bins, y, drawn, at = block
        to = np.full_like(at, -1)
        for t, (feature, cut, child) in steps.items():
            on = np.flatnonzero(at[t] >= 0)
            node = at[t][on]
            to[t][on] = child[node, (bins[on, feature[node]] > cut[node]).astype(np.int8)]
        return bins, y, drawn, to

    return run


def _count(drawn_features: dict[int, np.ndarray], kind: type):
    """Drawn rows of each tree by open node, drawn feature, bin and class."""

    def run(blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        total = {t: np.zeros(f.size * BINS * 2, kind) for t, f in drawn_features.items()}
        for bins, y, drawn, at in blocks:
            for t, features in drawn_features.items():
                on = np.flatnonzero(at[t] >= 0)
                if not len(on):
                    continue
                node, picked = at[t][on].astype(np.int64), features.shape[1]
                cell = (node * picked)[:, None] + np.arange(picked)
                cell = ((cell * BINS + bins[on[:, None], features[node]]) * 2 + y[on, None]).ravel()
                times = np.repeat(drawn[t][on], picked)
                if total[t].size <= 4 * len(cell):
                    total[t] += np.bincount(cell, weights=times, minlength=total[t].size).astype(kind)
                else:  # many nodes and few rows
                    np.add.at(total[t], cell, times.astype(kind))
        yield from ((t, c.reshape(*drawn_features[t].shape, BINS, 2)) for t, c in total.items())

    return run


def _pick(share: np.ndarray, leaf: int):
    """Best split of each node from its counts: whether there is one, slot of the drawn feature, bin, gain, counts of the node and of its left side by class."""

    def gini(c: np.ndarray) -> np.ndarray:
        w = c.sum(axis=-1)
        return 1 - np.divide((c**2).sum(axis=-1), w**2, out=np.ones_like(w), where=w > 0)

    def some(counts: np.ndarray) -> tuple[np.ndarray, ...]:
        left = counts.cumsum(axis=2, dtype=np.int64)
        whole = left[:, 0, -1]
        right = whole[:, None, None] - left
        enough = (left.sum(axis=-1) >= leaf) & (right.sum(axis=-1) >= leaf)
        w, l, r = whole * share, left * share, right * share
        n = np.maximum(w.sum(axis=-1), 1e-300)[:, None, None]
        gain = gini(w)[:, None, None] - l.sum(axis=-1) / n * gini(l) - r.sum(axis=-1) / n * gini(r)
        gain = np.where(enough, gain, -np.inf).reshape(len(counts), -1)
        best, every = gain.argmax(axis=1), np.arange(len(counts))
        gain = gain[every, best]
        slot, cut = best // BINS, best % BINS
        return gain > 1e-15, slot, cut, gain, whole, left[every, slot, cut]

    return lambda counts: tuple(np.concatenate(c) for c in zip(*[some(counts[a : a + SLICE]) for a in range(0, len(counts), SLICE)]))


class _Tree:
    """Nodes of a growing tree: feature, bin, left child (-1: a leaf; the right child is the next one), gain, counts by class."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.gain = (np.full(1, v) for v in (0, 0, -1, 0.0))
        self.counts = np.zeros((1, 2), np.int64)
        self.open, self.levels = np.zeros(1, np.int64), [0, 1]

    def grow(self, features: np.ndarray, picked: tuple, leaf: int, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Splits the open nodes and says where their rows go."""
        ok, slot, cut, gain, whole, left = picked
        feature = features[np.arange(len(slot)), slot].astype(np.int64)
        if len(self.levels) == 2:
            self.counts[0] = whole[0]
        at, size = self.open[ok], len(self.left)
        self.feature[at], self.cut[at], self.gain[at] = feature[ok], cut[ok], gain[ok]
        self.left[at] = size + 2 * np.arange(len(at))
        sides = np.stack([left[ok], (whole - left)[ok]], axis=1).reshape(-1, 2)
        for name, new in (("feature", 0), ("cut", 0), ("left", -1), ("gain", 0.0)):
            setattr(self, name, np.concatenate([getattr(self, name), np.full(len(sides), new)]))
        self.counts = np.concatenate([self.counts, sides])
        self.levels.append(len(self.left))
        on = (sides > 0).all(axis=1) & (sides.sum(axis=1) >= 2 * leaf) & (not last)
        self.open = size + np.flatnonzero(on)
        child = np.full((len(ok), 2), -1, np.int64)
        child[ok] = np.where(on, on.cumsum() - 1, -1).reshape(-1, 2)
        return feature, cut, child

    def finish(self, share: np.ndarray, width: int) -> tuple[Tree, np.ndarray]:
        """The tree with like leaves merged, and its features' parts in the fall of impurity."""
        weight = self.counts * share
        says = weight.argmax(axis=1)
        for a, b in reversed(list(zip(self.levels, self.levels[1:]))):
            at = a + np.flatnonzero(self.left[a:b] >= 0)
            below = self.left[at]
            same = (self.left[below] < 0) & (self.left[below + 1] < 0) & (says[below] == says[below + 1])
            self.left[at[same]] = -1
        # Nodes under a merged leaf are not reached from the root and do not count.
        tree = Tree.of(self.left, self.left + 1, self.feature, self.cut, weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-300))
        met = np.zeros(len(self.left), bool)
        met[0] = True
        for a, b in zip(self.levels, self.levels[1:]):
            at = a + np.flatnonzero(met[a:b] & (self.left[a:b] >= 0))
            met[self.left[at]] = met[self.left[at] + 1] = True
        inner = met & (self.left >= 0)
        fall = np.bincount(self.feature[inner], weights=(self.gain * weight.sum(axis=1))[inner], minlength=width)
        return tree, fall / fall.sum() if fall.sum() > 0 else fall


def _groups(trees: dict[int, _Tree]) -> Iterator[list[int]]:
    group, nodes = [], 0
    for t, tree in trees.items():
        if group and nodes + len(tree.open) > NODES:
            yield group
            group, nodes = [], 0
        group.append(t)
        nodes += len(tree.open)
    if group:
        yield group


def fit(rows: DataFrame, features: list[str], weights: dict[int, float], trees: int = 100, depth: int = 15, leaf: int = 5) -> ForestModel:
    """Forest on rows with ``features``, ``y`` (0 or 1) and ``weight``; ``weights`` gives the weight of a row by class."""
    width = len(features)
    picked = int(np.ceil(np.sqrt(width)))
    share = np.array([weights.get(0, 0.0), weights.get(1, 0.0)])
    binned = Binned.of(rows, features)
    parts = rows.sparkSession.sparkContext.defaultParallelism
    # There are as many draws as rows in expectation, so counts stay far below the range.
    kind = np.int32 if rows.count() < 1 << 29 else np.int64
    grown = {t: _Tree() for t in range(trees)}
    states = binned.blocks.map(_bag(trees, np.int16 if depth <= 15 else np.int32)).persist(StorageLevel.MEMORY_AND_DISK)
    kept: list[RDD] = [states]
    try:
        for level in range(depth):
            open_ = {t: tree for t, tree in grown.items() if len(tree.open)}
            if not open_:
                break
            drawn, steps = {}, {}
            for t, tree in open_.items():
                order = np.random.default_rng([SEED, t, level]).random((len(tree.open), width)).argpartition(picked - 1, axis=1)
                drawn[t] = order[:, :picked].astype(np.int16)
            for group in _groups(open_):
                counted = states.mapPartitions(_count({t: drawn[t] for t in group}, kind)).reduceByKey(np.add, min(parts, len(group)))
                for t, best in counted.mapValues(_pick(share, leaf)).collect():  # a few numbers a node, as the model holds
                    steps[t] = open_[t].grow(drawn[t], best, leaf, level == depth - 1)
            for old in kept[:-1]:
                old.unpersist()
            if level == 0:
                binned.blocks.unpersist()
            states = states.map(_move(steps)).persist(StorageLevel.MEMORY_AND_DISK)
            kept = [kept[-1], states]
    finally:
        for old in (*kept, binned.blocks):
            old.unpersist()
    finished = [tree.finish(share, width) for tree in grown.values()]
    parts_of = sum(fall for _, fall in finished)
    return ForestModel(Forest(features, binned.cuts, [tree for tree, _ in finished]), parts_of / parts_of.sum() if parts_of.sum() > 0 else parts_of)
