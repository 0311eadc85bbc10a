"""Boosted trees stopped by the validation curve, and a grid of settings fitted side by side.

Spark's boosting has no way to go on from a fitted model, so a longer fit would begin anew, and every fit would
cut the features into bins again. Here the rows are put into bins once (:class:`Binned`) and all fits share them; a tree is
grown level by level, one Spark job a level: tasks add up counts, weights and residuals by node, feature and
bin, the driver picks the splits from these sums. A fit goes on from the trees it has.

Rounds come in blocks that double, and after each the new prefixes of the trees are rated in one pass over the
validation rows: a task adds up the trees' outputs row by row, and the exact precision-recall curves of all prefixes come
from one range-sorted running sum. The scan over prefixes stops as soon as ``patience`` rounds bring no
gain, and the model is the best prefix until then.

Rows without labels take no part; a validation part without positives gains nothing, so the
first tree alone is kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.operators.metrics import confusion, with_rates
from tidemark.operators.ml import SEED, spread
from tidemark.session import materialise

#: Rounds at most, rounds without gain that end the fit, and the settings of the known model.
ROUNDS, PATIENCE = 1000, 50
SETTING = {"depth": 6, "rate": 0.05, "sample": 0.8, "columns": 0.8, "leaf": 5, "gain": 0.0}
#: The known grid of 144 settings; ``gain`` is a share of variance here and a loss there.
GRID = {"depth": [4, 6, 8], "rate": [0.03, 0.05, 0.1], "leaf": [1, 5], "sample": [0.8, 1.0], "columns": [0.8, 1.0], "gain": [0.0, 0.01]}
BLOCK = 64
#: Bins of a feature, rows of a block that a task works on at a time, and rounds after which margins are added up from the trees again, to keep the lineage short.
BINS, ROWS, CHAIN = 32, 1 << 16, 32
#: Rows that a task is worth.
LEAST = 1 << 13
#: Rows in expectation that the borders of bins are taken from (those of the library as well).
SAMPLE = 10000

_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_WEIGHT = re.compile(r"Tree \d+ \(weight (\S+)\):")


@dataclass
class Trees:
    """Regression trees as arrays (feature, threshold, left, right, value; a leaf's children are itself) with their weights."""

    features: list[str]
    nodes: list[tuple[np.ndarray, ...]]
    weights: list[float]
    depth: int

    @staticmethod
    def of(described: str, features: list[str], depth: int) -> Trees:
        """From a fitted ensemble's description, which spells out every split and leaf in full."""
        nodes: list[tuple[np.ndarray, ...]] = []
        weights: list[float] = []
        rows: list[list[float]] = []
        waiting: list[tuple[int, bool]] = []  # (parent, whether the next node is its right child)

        def place(row: list[float]) -> None:
            if waiting:
                parent, right = waiting.pop()
                rows[parent][3 if right else 2] = len(rows)
            rows.append(row)

        def close() -> None:
            if rows:
                t = np.array(rows)
                nodes.append((t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4]))
                rows.clear()

        for line in described.splitlines():
            line = line.strip()
            if m := _WEIGHT.match(line):
                close()
                weights.append(float(m[1]))
            elif m := _SPLIT.match(line):
                at = len(rows)
                place([float(m[1]), float(m[2]), at, at, 0.0])
                waiting += [(at, True), (at, False)]
            elif line.startswith("Predict:"):
                at = len(rows)
                place([0.0, 0.0, at, at, float(line[8:])])
        close()
        return Trees(features, nodes, weights, depth)

    def first(self, n: int) -> Trees:
        return Trees(self.features, self.nodes[:n], self.weights[:n], self.depth)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sum of the first 1, 2, … trees of every row (rows by trees)."""
        out = np.zeros((len(x), len(self.nodes)))
        every = np.arange(len(x))
        for k, (feature, threshold, left, right, value) in enumerate(self.nodes):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[every, feature[at]] <= threshold[at], left[at], right[at])
            out[:, k] = self.weights[k] * value[at]
        return np.cumsum(out, axis=1)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p``, the probability of class 1."""
        whole, features = self, self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], axis=1)
                margin = whole.margins(x)[:, -1] if whole.nodes else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-2 * margin)))], names=[*b.schema.names, "p"])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, f"{kinds}, p double")


def weighted(train: DataFrame, features: list[str]) -> DataFrame:
    """Features, label and ``weight``: positives weigh as the negative-to-positive ratio of the rows."""
    counts = train.agg(F.sum("y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    ratio = F.when(F.col("y") == 1, F.try_divide(F.col("_n") - F.col("_p"), F.col("_p"))).otherwise(1.0)
    return attach(train.select(*features, "y"), counts).select(*features, "y", F.coalesce(ratio, F.lit(1.0)).alias("weight"))


def _cuts(values: np.ndarray) -> np.ndarray:
    """Borders of at most ``BINS`` bins, half way between neighbouring values: all of them if these are few, else at even shares of the rows."""
    values = np.sort(values[~np.isnan(values)])
    distinct = np.unique(values)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(distinct) <= BINS:
        return middle
    at = np.searchsorted(distinct, values[len(values) * np.arange(1, BINS) // BINS])
    return np.unique(middle[np.minimum(at, len(middle) - 1)])


@dataclass
class Binned:
    """Rows cut into bins by quantiles of each feature, kept as arrays in even parts; any number of fits read them."""

    features: list[str]
    #: Thresholds of each feature, in order, by quantiles; a value's bin is the number of thresholds below it, a missing value lies above all.
    cuts: list[np.ndarray]
    #: Blocks (place, bins, label as 1 or -1, weight).
    blocks: RDD

    @staticmethod
    def of(rows: DataFrame, features: list[str]) -> Binned:
        """From rows with ``features``, ``y`` and ``weight``."""
        rows = rows.select(*[F.col(f).cast("double").alias(f) for f in features], "y", F.col("weight").cast("double").alias("weight")).filter("y IS NOT NULL")
        n = rows.count()
        if not n:
            raise ValueError("no labelled rows to fit")
        drawn = rows.select(*features).sample(min(1.0, SAMPLE / n), SEED).toArrow()  # bounded, for the bins alone
        cuts = [_cuts(drawn.column(f).to_numpy().astype(float)) for f in features]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                get = lambda c: b.column(c).to_numpy(zero_copy_only=False)
                bins = np.stack([np.searchsorted(v, get(f).astype(float)) for f, v in zip(features, cuts)], axis=1).astype(np.uint8)
                sign = np.where(get("y") == 1, 1, -1).astype(np.int8)
                yield pa.RecordBatch.from_pylist([{"bins": bins.tobytes(), "sign": sign.tobytes(), "weight": get("weight").astype(float).tobytes()}])

        def join(part: int, got: Iterator) -> Iterator[tuple]:
            def block(rows: list) -> tuple:
                sign = np.frombuffer(b"".join(r["sign"] for r in rows), np.int8)
                bins = np.frombuffer(b"".join(r["bins"] for r in rows), np.uint8).reshape(len(sign), -1)
                return (part, at), bins, sign, np.frombuffer(b"".join(r["weight"] for r in rows))

            at, waiting, n = 0, [], 0
            for r in got:
                waiting.append(r)
                n += len(r["sign"])
                if n >= ROWS:
                    yield block(waiting)
                    at, waiting, n = at + 1, [], 0
            if n:
                yield block(waiting)

        packed = materialise(rows.mapInArrow(run, "bins binary, sign binary, weight binary"))
        # A level is one job: few rows are not worth a task on every core.
        packed = packed.coalesce(min(packed.rdd.getNumPartitions(), -(-n // LEAST)))
        return Binned(features, cuts, packed.rdd.mapPartitionsWithIndex(join).persist(StorageLevel.MEMORY_AND_DISK))

    def walk(self, tree: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """A tree of thresholds as one of bins: feature, bin, left, right, value."""
        feature, threshold, left, right, value = tree
        cut = [np.searchsorted(self.cuts[f], t) if len(self.cuts[f]) else 0 for f, t in zip(feature, threshold)]
        return feature, np.array(cut, np.int64), left, right, value


def _ends(tree: tuple[np.ndarray, ...], bins: np.ndarray, depth: int) -> np.ndarray:
    """Node of each row after ``depth`` steps."""
    feature, cut, left, right, _ = tree
    at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for _ in range(depth):
        at = np.where(bins[every, feature[at]] <= cut[at], left[at], right[at])
    return at


def _sums(states: RDD, tree: tuple[np.ndarray, ...], level: int, wanted: np.ndarray, width: int, number: int, sample: float) -> np.ndarray:
    """Counts, weights and weighted residuals of the round's rows by wanted node, feature and bin: (3, nodes, features, bins)."""
    slot = np.full(len(tree[0]), -1, np.int64)
    slot[wanted] = np.arange(len(wanted))
    size = len(wanted) * BINS

    def run(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = np.zeros((3, width, size))
        for place, bins, sign, weight, margin in blocks:
            node = slot[_ends(tree, bins, level)]
            drawn = node >= 0
            if sample < 1:
                drawn &= np.random.default_rng([SEED, number, *place]).random(len(sign)) < sample
            on = np.flatnonzero(drawn)
            y, w, at, mine = sign[on], weight[on], node[on] * BINS, bins[on]
            residual = w * (4 * y / (1 + np.exp(2 * y * margin[on])) if number else y)
            for j in range(width):
                cell = at + mine[:, j]
                total[0, j] += np.bincount(cell, minlength=size)
                total[1, j] += np.bincount(cell, weights=w, minlength=size)
                total[2, j] += np.bincount(cell, weights=residual, minlength=size)
        yield total

    parts = states.mapPartitions(run).collect()  # nodes times features times bins, whatever the rows
    return sum(parts).reshape(3, width, len(wanted), BINS).swapaxes(1, 2)


def _grow(states: RDD, binned: Binned, number: int, depth: int, sample: float, columns: float, leaf: int, gain: float) -> tuple[np.ndarray, ...]:
    """One regression tree on the residuals of ``states``, level by level, by the fall of their weighted variance."""
    width = len(binned.features)
    picked = max(1, int(np.ceil(columns * width)))
    draw = np.random.default_rng([SEED, number])
    rows = [[0, 0, 0, 0, 0.0]]  # feature, bin, left, right, value
    allowed = np.zeros((width, BINS), bool)
    for j, values in enumerate(binned.cuts):
        allowed[j, : len(values)] = True
    open_, known = [0], {}  # nodes that may split; sums by node, and (node, its parent, its sibling) where they are a difference
    ask, rest = [0], []
    for level in range(depth):
        tree = tuple(np.array(c) for c in zip(*rows))
        got = _sums(states, tree, level, np.array(ask), width, number, sample)
        sums = {n: got[:, i] for i, n in enumerate(ask)}
        for n, parent, sibling in rest:
            sums[n] = known[parent] - sums[sibling]
        known, ask, rest, following = sums, [], [], []
        for n in open_:
            upto = sums[n].cumsum(axis=2)
            count, weight, residual = upto
            c, w, r = (v[0, -1] for v in upto)
            if level == 0:
                rows[0][4] = r / w if w > 0 else 0.0
            mine = np.zeros(width, bool)
            mine[draw.permutation(width)[:picked]] = True
            ok = allowed & mine[:, None] & (count >= leaf) & (c - count >= leaf) & (weight > 0) & (w - weight > 0)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                fall = np.where(ok, (residual**2 / weight + (r - residual) ** 2 / (w - weight) - r**2 / w) / w, -np.inf)
            j, b = np.unravel_index(fall.argmax(), fall.shape)
            if fall[j, b] < gain or fall[j, b] <= 1e-15:
                continue
            left = len(rows)
            rows[n][:4] = [int(j), int(b), left, left + 1]
            sides = [(left, count[j, b], weight[j, b], residual[j, b]), (left + 1, c - count[j, b], w - weight[j, b], r - residual[j, b])]
            rows += [[0, 0, k, k, rr / ww] for k, _, ww, rr in sides]
            splits = [k for k, cc, _, _ in sides if cc >= 2 * leaf]
            following += splits
            if len(splits) == 2:  # the smaller one is added up, the other is what it leaves of the parent
                small, large = sorted(sides, key=lambda v: v[1])
                ask.append(small[0])
                rest.append((large[0], n, small[0]))
            else:
                ask += splits
        open_ = following
        if not open_:
            break
    feature, cut, left, right, value = (np.array(c) for c in zip(*rows))
    threshold = [binned.cuts[f][b] if l != i else 0.0 for i, (f, b, l) in enumerate(zip(feature, cut, left))]
    return feature, np.array(threshold, float), left, right, value.astype(float)


def fit_trees(rows: DataFrame | Binned, features: list[str], rounds: int, depth: int, rate: float, sample: float, columns: float, leaf: int, gain: float, begun: Trees | None = None) -> Trees:
    """``rounds`` trees by logistic loss on weighted rows, those of ``begun`` included, which come from the same rows and setting."""
    binned = rows if isinstance(rows, Binned) else Binned.of(rows, features)
    trees = Trees(features, list(begun.nodes) if begun else [], list(begun.weights) if begun else [], depth)
    states, cached = None, []

    def added(new: list[tuple], weights: list[float], fresh: bool):
        def run(block: tuple) -> tuple:
            place, bins, sign, weight = block[:4]
            margin = np.zeros(len(sign)) if fresh else block[4]
            for tree, share in zip(new, weights):
                margin = margin + share * tree[4][_ends(tree, bins, depth)]
            return place, bins, sign, weight, margin

        return run

    try:
        for number in range(len(trees.nodes), rounds):
            if states is None or len(cached) >= CHAIN:
                old, cached = cached, []
                states = binned.blocks.map(added([binned.walk(t) for t in trees.nodes], trees.weights[:], True))
            else:
                old = cached[-1:]
                states = states.map(added([binned.walk(trees.nodes[-1])], trees.weights[-1:], False))
            cached.append(states.persist(StorageLevel.MEMORY_AND_DISK))
            trees.nodes.append(_grow(states, binned, number, depth, sample, columns, leaf, gain))
            trees.weights.append(rate if number else 1.0)
            for r in old:
                r.unpersist()
    finally:
        for r in cached:
            r.unpersist()
    return trees


def prefix_precision(trees: Trees, rows: DataFrame, after: int = 0) -> list[float]:
    """Average precision over ``rows`` of the first after+1, after+2, … trees, by their exact curves.

    Margins are dealt out to ranges, whose borders come from a sample of the rows, and travel packed: a task sorts one range of
    one prefix, and sums of earlier ranges are carried into the next.
    """
    features, first = trees.features, after
    n = rows.count()
    parts = max(1, -(-n // ROWS))
    table = lambda b: np.stack([b.column(f).to_numpy().astype(float) for f in features], axis=1)
    drawn = rows.select(*features).sample(min(1.0, 50 * parts / max(n, 1)), SEED).toArrow() if parts > 1 else None
    shares = np.arange(1, parts) / parts
    if drawn is None or not len(drawn):
        borders = np.zeros((0, len(trees.nodes) - after))
    else:
        borders = np.quantile(-trees.margins(table(drawn))[:, after:], shares, axis=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], axis=1)
            y = b.column("y").to_numpy(zero_copy_only=False) == 1
            margins = trees.margins(x)[:, first:]
            out = []
            for k in range(margins.shape[1]):
                value, pos, neg = _counted(-margins[:, k], y, ~y)
                ends = [0, *np.searchsorted(value, borders[:, k]), len(value)]
                for part, (i, j) in enumerate(zip(ends, ends[1:])):
                    if i < j:
                        out.append((k, part, value[i:j].tobytes(), pos[i:j].tobytes(), neg[i:j].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k", "part", "low", "pos", "neg"])

    def merge(group: pa.Table) -> pa.Table:
        low, pos, neg = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("low", float), ("pos", np.int64), ("neg", np.int64)))
        _, pos, neg = _counted(low, pos, neg)
        key = [group.column(c)[0].as_py() for c in ("k", "part")]
        return pa.table([pa.array([v]) for v in (*key, pos.tobytes(), neg.tobytes(), int(pos.sum()), int(neg.sum()))], names=["k", "part", "pos", "neg", "n_pos", "n_neg"])

    dealt = rows.select(*features, "y").mapInArrow(deal, "k long, part long, low binary, pos binary, neg binary")
    kinds = "k long, part long, pos binary, neg binary, n_pos long, n_neg long"
    sorted_ = materialise(dealt.groupBy("k", "part").applyInArrow(merge, kinds))
    n_pos = sorted_.filter("k = 0").agg(F.sum("n_pos")).first()[0]
    if not n_pos:
        return [0.0] * (len(trees.nodes) - after)
    earlier = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sorted_.select("k", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("n_pos", "n_neg")])

    def area(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                pos, neg = np.frombuffer(r["pos"], np.int64), np.frombuffer(r["neg"], np.int64)
                tp, fp = r["n_pos"] + pos.cumsum(), r["n_neg"] + neg.cumsum()
                out.append((r["k"], r["part"], float((pos * (tp / (tp + fp))).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["k", "part", "area"])

    areas = sorted_.drop("n_pos", "n_neg").join(carried, ["k", "part"]).mapInArrow(area, "k long, part long, area double")
    got = np.zeros(len(trees.nodes) - after)
    for r in sorted(areas.collect()):  # one row per prefix and range
        got[r["k"]] += r["area"]
    return [float(v) / n_pos for v in got]


def _counted(low: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct values in order and their sums of ``pos`` and ``neg``."""
    value, at = np.unique(low, return_inverse=True)
    add = lambda c: np.bincount(at, weights=c, minlength=len(value)).astype(np.int64)
    return value, add(pos), add(neg)


@dataclass
class Fit:
    trees: Trees
    #: Average precision over the validation rows after each round that was looked at.
    curve: list[float]

    @property
    def best(self) -> int:
        return len(self.trees.nodes)


def best_prefix(curve: list[float], patience: int) -> tuple[int, bool]:
    """Rounds of the best prefix in a scan that ends after ``patience`` rounds without gain, and whether it ended."""
    best, top = 1, float("-inf")
    for k, value in enumerate(curve, 1):
        if value > top:
            best, top = k, value
        elif k - best >= patience:
            return best, True
    return best, False


def fit_staged(train: DataFrame, val: DataFrame, features: list[str], rounds: int = ROUNDS, patience: int = PATIENCE, block: int = BLOCK, **setting) -> Fit:
    """Boosted trees on ``train`` (features and y), stopped and cut back by average precision on ``val``."""
    setting = {**SETTING, **setting}
    rows = Binned.of(spread(weighted(train, features)), features)
    held = materialise(val.select(*features, "y").filter("y IS NOT NULL"))
    curve: list[float] = []
    size = min(block, rounds)
    trees = None
    while True:
        trees = fit_trees(rows, features, size, **setting, begun=trees)
        curve += prefix_precision(trees, held, len(curve))
        best, ended = best_prefix(curve, patience)
        if ended or size >= rounds:
            rows.blocks.unpersist()
            return Fit(trees.first(best), curve)
        size = min(2 * size, rounds)


def settings(grid: dict[str, list] = GRID) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def search(train: DataFrame, val: DataFrame, features: list[str], grid: list[dict], rungs: tuple[int, ...], keep: float = 0.25, parallel: int = 8, threshold: float = 0.5):
    """Fit every setting side by side over one stored table; rank by F1 on ``val``. Returns (best trees, results).

    ``rungs`` are numbers of rounds: all settings take the first, the best ``keep`` of them the next, and
    so on. With one rung nothing is dropped. The results have a row per setting with the rounds that it
    came to, its rates there, and ``dropped`` (false for those on the last rung). ``parallel`` bounds how many
    fits run at a time; each is a chain of small jobs, which leave room for each other's.
    """
    spark = train.sparkSession
    rows = Binned.of(spread(weighted(train, features)), features)
    held = materialise(val.select(*features, "y"))

    def rate(setting: dict, rounds: int, begun: Trees | None) -> tuple[Trees, tuple]:
        trees = fit_trees(rows, features, rounds, **{**SETTING, **setting}, begun=begun)
        r = with_rates(confusion(trees.score(held), F.col("p") >= threshold)).first()
        return trees, (r["tp"], r["fp"], r["tn"], r["fn"], r["precision"], r["recall"], r["f1"])

    alive = list(range(len(grid)))
    last: dict[int, tuple[int, Trees, tuple]] = {}
    with ThreadPoolExecutor(parallel) as pool:
        for step, rounds in enumerate(rungs):
            runs = {i: pool.submit(inheritable_thread_target(spark)(rate), grid[i], rounds, last[i][1] if i in last else None) for i in alive}
            for i, run in runs.items():
                last[i] = (rounds, *run.result())
            alive.sort(key=lambda i: (-last[i][2][-1], i))
            if step + 1 < len(rungs):
                alive = alive[: max(1, round(len(alive) * keep))]
    rows.blocks.unpersist()
    names = list(grid[0])
    table = [(*(float(grid[i][n]) for n in names), last[i][0], i not in alive, *last[i][2]) for i in range(len(grid))]
    schema = ", ".join(f"{n} double" for n in names) + ", rounds long, dropped boolean, tp long, fp long, tn long, fn long, precision double, recall double, f1 double"
    return last[alive[0]][1], spark.createDataFrame(table, schema).orderBy("dropped", F.desc("f1"))
