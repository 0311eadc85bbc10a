"""Embedding near-duplicates by a forest of random-projection trees with spill.

Equal vectors are one class from the start. Each tree splits the unit vectors again and again along a
random direction; rows closer to a split than the spill width go to both sides. Of a few random
directions and thresholds around the median, a node takes the split that lies in the thinnest place,
and one that would cut through a dense cluster is not made, so such a cluster stays in one leaf. The
trees are fitted on a bounded sample (``sample`` classes); every class is routed through all of them.

Classes are compared within leaves by cosine in double precision. Each class carries the leaves it
reached in the whole forest, so a pair that shares several leaves is counted in the first only: link
counts come without gathering pairs, and each leaf gives one star per cluster for the components. A
leaf over ``block`` classes is dealt out to pairs of blocks, which bounds every task's memory.

Vectors that are null, zero or hold null or non-finite components link with nothing, nor do vectors of
another length than the sample's first (they are classes, but no tree takes them). Repeated rows are
copies of each other and count as links. An empty table gives an empty result. Other columns are not
read; components of the result are named by the smallest id (a null id only if all are null).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.tables import Table

TREES, LEAF, SAMPLE, BLOCK = 8, 128, 200_000, 4096
#: Spill width in standard deviations of a borderline pair's projected difference; widest share of
#: a node's rows that may stand within it; random directions tried for a split.
SPILL, SHARE, TRIES = 0.5, 0.4, 4
_TILE = 1024


@dataclass
class Node:
    direction: np.ndarray | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1
    leaf: int = -1


@dataclass
class Forest:
    dims: int
    spill: float
    trees: list[list[Node]]
    leaves: int

    def route(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that each row reaches, in order of leaf number."""
        rows: list[np.ndarray] = []
        leaves: list[np.ndarray] = []
        for tree in self.trees:
            stack = [(0, np.arange(len(units)))]
            while stack:
                at, own = stack.pop()
                if not len(own):
                    continue
                node = tree[at]
                if node.direction is None:
                    rows.append(own)
                    leaves.append(np.full(len(own), node.leaf, np.int64))
                    continue
                p = units[own] @ node.direction - node.threshold
                stack += [(node.left, own[p <= self.spill]), (node.right, own[p >= -self.spill])]
        row, leaf = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, leaves))
        order = np.argsort(leaf, kind="stable")
        return row[order], leaf[order]


def fit_forest(units: np.ndarray, cosine: float, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> Forest:
    dims = units.shape[1] if len(units) else 0
    spill = SPILL * np.sqrt((2 - 2 * cosine) / max(1, dims))
    rng, made, leaves = np.random.default_rng(seed), [], 0
    for _ in range(trees):
        tree = [Node()]
        stack = [(0, np.arange(len(units)))]
        while stack:
            at, own = stack.pop()
            best = (SHARE, None, 0.0)
            if len(own) > leaf:
                for _ in range(TRIES):
                    d = rng.standard_normal(dims)
                    d /= np.linalg.norm(d)
                    p = np.sort(units[own] @ d)
                    cuts = p[(np.linspace(0.3, 0.7, 21) * (len(p) - 1)).astype(int)]
                    near = (np.searchsorted(p, cuts + spill, "right") - np.searchsorted(p, cuts - spill)) / len(p)
                    k = int(near.argmin())
                    if near[k] < best[0]:
                        best = (near[k], d, float(cuts[k]))
            if best[1] is None:
                tree[at].leaf = leaves
                leaves += 1
                continue
            p = units[own] @ best[1] - best[2]
            tree[at] = Node(best[1], best[2], len(tree), len(tree) + 1)
            tree += [Node(), Node()]
            stack += [(tree[at].left, own[p <= spill]), (tree[at].right, own[p >= -spill])]
        made.append(tree)
    return Forest(dims, float(spill), made, leaves)


def unit_rows(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors of ``dims`` valid components as double unit rows."""
    flat = np.asarray(vectors.flatten(), dtype=np.float64).reshape(-1, dims)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each vector; null if it can link with nothing."""
    for batch in batches:
        out: list[bytes | None] = []
        for x in batch.column(1):
            v = None if not x.is_valid or x.values.null_count else np.asarray(x.values, dtype=np.float64) + 0.0
            usable = v is not None and len(v) and np.isfinite(v).all() and v.any()
            out.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if usable else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=batch.schema.names + ["node"])


def _compare(units: np.ndarray, weight: np.ndarray, leaf: int, seen: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a group, the weight of its links first found here, and the first row of its cluster.

    ``seen`` holds every row's leaves (padded with -1 and lower); ``side`` is 0, or 0 and 1 where two
    blocks meet, and then only pairs across are looked at.
    """
    n = len(units)
    links, label = np.zeros(n, np.int64), np.arange(n)
    two = side.max() > 0
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(n), np.arange(n))
    for i in range(0, len(left), _TILE):
        for j in range(0 if two else i, len(right), _TILE):
            a, b = left[i : i + _TILE], right[j : j + _TILE]
            x, y = np.nonzero(units[a] @ units[b].T >= cosine)
            x, y = a[x], b[y]
            if not two:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            before = np.zeros(len(x), bool)
            for s in range(seen.shape[1]):
                own = seen[x, s]
                test = (own >= 0) & (own < leaf) & ~before
                if test.any():
                    before[test] = (seen[y[test]] == own[test, None]).any(axis=1)
            x, y = x[~before], y[~before]
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            while len(x):
                while True:
                    rx, ry = label[x], label[y]
                    if (label[rx] == rx).all() and (label[ry] == ry).all():
                        break
                    label[x], label[y] = label[rx], label[ry]
                apart = rx != ry
                x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
                np.minimum.at(label, np.maximum(rx, ry), np.minimum(rx, ry))
    while (label[label] != label).any():
        label = label[label]
    return links, label


def class_links(classes: DataFrame, cosine: float, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(node, hub, links): parts of each class's link weight, and stars that join linked classes.

    ``classes`` has the columns node (binary), n (copies) and v (vector), and is stored.
    """
    spark = classes.sparkSession
    total = classes.count()
    # The sample is chosen by the digest, so it does not depend on how rows are stored.
    place = F.conv(F.substring(F.hex("node"), 1, 12), 16, 10).cast("double") / float(1 << 48)
    some = classes.filter(place < min(1.0, sample / max(1, total))).select("v").toArrow()["v"].combine_chunks()
    sizes = np.diff(some.offsets.to_numpy()) if len(some) else np.zeros(0, int)
    dims = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    some = some.filter(pa.array(sizes == dims)) if len(some) else some
    forest = spark.sparkContext.broadcast(fit_forest(unit_rows(some, dims) if len(some) else np.zeros((0, 1)), cosine, trees, leaf))

    def routed(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        v = batch.column("v")
        fits = np.array([len(x.values) == forest.value.dims for x in v], bool)
        batch = batch.filter(pa.array(fits))
        units = unit_rows(batch.column("v"), forest.value.dims) if batch.num_rows else np.zeros((0, max(1, forest.value.dims)))
        row, at = forest.value.route(units)
        return batch, units, row, at

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(forest.value.leaves, np.int64)
        for batch in batches:
            count += np.bincount(routed(batch)[3], minlength=len(count))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["leaf", "n"])

    # At most one row per leaf, and leaves are bounded by the sample.
    rows = classes.mapInArrow(sized, "leaf bigint, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    parts = np.ones(max(1, forest.value.leaves), np.int64)
    for r in rows:
        parts[r["leaf"]] = -(-r["n"] // block)
    deal = spark.sparkContext.broadcast(parts)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch, _, row, at = routed(batch)
            seen = [[] for _ in range(batch.num_rows)]
            for r, x in zip(row.tolist(), at.tolist()):
                seen[r].append(x)
            low = np.array([int.from_bytes(x.as_py()[8:], "big") >> 1 for x in batch.column("node")], np.int64)
            take, first, second, side = [], [], [], []
            for k, (r, x) in enumerate(zip(row.tolist(), at.tolist())):
                p = int(deal.value[x])
                b = int(low[r] % p)
                for o in range(p):
                    take.append(k)
                    first.append(min(b, o))
                    second.append(max(b, o))
                    side.append(int(b > o))
            take = np.array(take, np.int64)
            source = batch.take(pa.array(row[take]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[take]), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(side, pa.int64())]
                + [source.column("node"), source.column("n"), source.column("v"), pa.array([seen[r] for r in row[take].tolist()], pa.list_(pa.int64()))],
                names=["leaf", "i", "j", "side", "node", "n", "v", "seen"],
            )

    vector = classes.schema["v"].dataType.simpleString()
    dealt = classes.mapInArrow(spread, f"leaf bigint, i bigint, j bigint, side bigint, node binary, n bigint, v {vector}, seen array<bigint>")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if held and any(held[0].column(c)[0].as_py() != int(keys[c, a]) for c in range(3)):
                    yield from group(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from group(held)

    def group(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        if t.num_rows < 2:
            return
        col = lambda c: t[c].combine_chunks()
        lists = col("seen")
        width = np.diff(lists.offsets.to_numpy())
        seen = np.full((t.num_rows, int(width.max())), -1, np.int64)
        seen[np.arange(seen.shape[1])[None, :] < width[:, None]] = lists.flatten().to_numpy()
        links, label = _compare(unit_rows(col("v"), forest.value.dims), t["n"].to_numpy(), t["leaf"][0].as_py(), seen, t["side"].to_numpy(), cosine)
        at = np.flatnonzero(links)
        if len(at):
            node = col("node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(at)), node.take(pa.array(label[at])), pa.array(links[at])], names=["node", "hub", "links"])

    ordered = dealt.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j")
    return ordered.mapInArrow(compared, "node binary, hub binary, links bigint")


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.95,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """``id_col``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    kinds = [f.dataType.simpleString() for f in src.schema]
    members = Table(src.mapInArrow(_digests, f"id {kinds[0]}, v {kinds[1]}, node binary")).df
    classes = Table(
        members.filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.first("v").alias("v"))
    ).df
    found = Table(class_links(classes.select("node", "n", "v"), cosine, trees, leaf, sample, block)).df
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("hub").alias("b"))).df
    rooted = (
        classes.select("node", "n", "low")
        .join(roots, "node", "left")
        .join(links, "node", "left")
        .select("node", "low", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    per_class = rooted.join(lowest, "root").select("node", "n_links", "component_id")
    out = members.select("id", "node").join(per_class, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
    )
