"""SimHash near-duplicates by a Gray-order hierarchical index.

A fingerprint is the bitwise majority over the XXH64 hashes of a text's word shingles. Documents with
equal fingerprints are one class from the start. Two fingerprints that differ in at most ``distance``
bits agree in at least ``blocks - distance`` of ``blocks`` bit blocks, so each class goes, once per
choice of two blocks, to the group of classes that agree there. In a group, fingerprints stand in Gray
order, where neighbours share bits; runs of eight become a node that keeps the bits all of them share
(mask and pattern), runs of eight nodes the next, up to one root. The self-join walks pairs of nodes
from the root: the bits that differ among those shared by both nodes are a lower bound for every pair
below, and a pair of nodes over the distance is dropped whole. Of the links found, those that span a
group's clusters go out, never all pairs; a group over ``group_limit`` classes is dealt out to pairs of parts.

Words are runs of other than ASCII white space, A-Z in lower case. A text with fewer words than a
shingle counts as one shingle of all its words; null, empty and white-space texts have fingerprint 0,
which is linked like any other. Repeated rows share their class. A null id never names a component
unless all ids of the component are null. An empty table gives an empty result. Other columns are not
read. A very long text is one task's work, linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_trie import slices
from tidemark.llm.components import components
from tidemark.llm.tables import Table

WORDS, SEED, DISTANCE = 4, 42, 4
FAN = 8
GROUP_LIMIT = 32_768
#: Pairs of nodes that are expanded at a time.
_FRONT = 1 << 17
#: From g, node and the other columns of some whole groups to pairs of rows.
Search = Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - words + 1
    shingles = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp", words: int = WORDS) -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long."""
    spot = docs.columns.index(text_col)
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words) for _, texts in slices(batch.column(spot)) for t in texts]
            cols = [c for i, c in enumerate(batch.columns) if i != spot]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())], names=[*rest, name])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), f"`{name}` bigint"]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each 64-bit pattern in the Gray code sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(prints: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Nodes of each level, leaves first: (first child, end child, mask, pattern); a node never spans groups."""
    n = len(prints)
    full = np.full_like(prints, np.uint64(0xFFFFFFFFFFFFFFFF))
    out = [(np.arange(n), np.arange(1, n + 1), full, prints)]
    own = group
    while True:
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        if len(starts) == len(own):
            return out
        place = np.arange(len(own)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(own)]])))
        first = np.flatnonzero(place % FAN == 0)
        end = np.concatenate([first[1:], [len(own)]])
        _, _, mask, pattern = out[-1]
        base = np.repeat(pattern[first], end - first, axis=0)
        same = np.bitwise_and.reduceat(mask & ~(pattern ^ base), first, axis=0)
        out.append((first, end, same, pattern[first] & same))
        own = own[first]


def near_pairs(levels: list[tuple[np.ndarray, ...]], distance: int, own: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of a group within ``distance``, some at a time; those of equal ``own`` are left out."""
    spans = [] if own is None else [(own, own)]
    for first, _, _, _ in levels[1:] if spans else ():
        spans.append((np.minimum.reduceat(spans[-1][0], first), np.maximum.reduceat(spans[-1][1], first)))
    top = np.arange(len(levels[-1][0]))
    stack = [(len(levels) - 1, top[i : i + _FRONT], top[i : i + _FRONT]) for i in range(0, len(top), _FRONT)]
    while stack:
        level, a, b = stack.pop()
        first, end, mask, pattern = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]).sum(axis=1) <= distance
        if level == 0:
            near &= a != b
        if spans:
            low, high = spans[level]
            near &= np.minimum(low[a], low[b]) != np.maximum(high[a], high[b])
        a, b = a[near], b[near]
        if not len(a):
            continue
        if level == 0:
            yield a, b
            continue
        # All pairs of children; of a node with itself, only one order.
        na, nb = end[a] - first[a], end[b] - first[b]
        total = na * nb
        for cut in range(0, len(a), max(1, _FRONT // (FAN * FAN))):
            some = slice(cut, cut + max(1, _FRONT // (FAN * FAN)))
            t = total[some]
            which = np.repeat(np.arange(len(a))[some], t)
            k = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            ca, cb = first[a[which]] + k // nb[which], first[b[which]] + k % nb[which]
            keep = (a[which] != b[which]) | (ca <= cb)
            stack.append((level - 1, ca[keep], cb[keep]))


def links_in_groups(prints: np.ndarray, group: np.ndarray, distances: tuple[int, ...] = (DISTANCE,)) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that span the clusters of each group, of all pairs within the last of ``distances``.

    ``prints`` has one row per fingerprint and a column per 64 bits; rows stand in order of group and
    Gray rank. Pairs within a smaller distance are taken first, so the spanning pairs are close ones.
    """
    levels = _levels(prints, group)
    label = np.arange(len(prints))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for distance in distances:
        # Nodes of one cluster are passed over whole from the second distance on.
        for a, b in near_pairs(levels, distance, label.copy() if found else None):
            _unite(label, a, b, found)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Merge the clusters of each pair, in place, and note one pair for each merge; labels point to earlier rows."""
    while True:
        while True:
            ra, rb = label[a], label[b]
            if (label[ra] == ra).all() and (label[rb] == rb).all():
                break
            label[a], label[b] = label[ra], label[rb]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            return
        later, one = np.unique(np.maximum(ra, rb), return_index=True)
        label[later] = np.minimum(ra, rb)[one]
        found.append((a[one], b[one]))


def _block_keys(distance: int) -> list[int]:
    """Masks of the bits kept for each choice of two of ``distance + 2`` blocks."""
    blocks = distance + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [sum(1 << i for i in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(bits, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(rows: DataFrame, cols: list[str], group_limit: int) -> DataFrame:
    """g, node and ``cols``: a group of over ``group_limit`` rows is dealt out to parts by the node's hash, and each pair of parts is a group."""
    heavy = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_limit).withColumnRenamed("n", "_n")
    parts = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(group_limit)).cast("int")
    return (
        rows.join(heavy, "g", "left")
        .withColumn("p", parts)
        .select("g", "node", *cols, F.pmod(F.xxhash64("node"), F.col("p")).cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("o"))
        .select(F.when(F.greatest("m", "o") == 0, F.col("g")).otherwise(F.xxhash64("g", F.least("m", "o"), F.greatest("m", "o"))).alias("g"), "node", *cols)
    )


def _linked(rows: DataFrame, prints: list[str], distances: tuple[int, ...], group_limit: int, search: Search | None = None) -> DataFrame:
    """Links (a, b) that span each group's clusters, or those that ``search`` finds. ``rows``: group key g, node, and columns of longs, fingerprints first."""
    rank = F.col(prints[0])
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = np.stack([c.to_numpy() for c in batch.columns])
            held.append(cols)
            cut = np.flatnonzero(cols[0] != cols[0, -1])
            if not len(cut) or sum(x.shape[1] for x in held) < (1 << 16):
                continue
            stop = int(cut[-1]) + 1  # the last group may go on
            held[-1] = cols[:, :stop]
            yield from joined(held)
            held = [cols[:, stop:]]
        if held:
            yield from joined(held)

    def joined(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cols = np.concatenate(held, axis=1)
        found = search(cols) if search else [links_in_groups(np.ascontiguousarray(cols[2:].T).view(np.uint64), cols[0], distances)]
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(cols[1, a]), pa.array(cols[1, b])], names=["a", "b"])

    # Gray rank as an unsigned number.
    ordered = dealt(rows, prints, group_limit).repartition("g").sortWithinPartitions("g", rank.bitwiseXOR(F.lit(-(1 << 63))))
    return ordered.select("g", "node", *prints).mapInArrow(run, "a bigint, b bigint")


def near_links(prints: DataFrame, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``prints.fp`` (distinct) within ``distance``."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(_signed(m))) for i, m in enumerate(_block_keys(distance))])
    return _linked(prints.select(F.explode(keys).alias("g"), F.col("fp").alias("node"), "fp"), ["fp"], (distance,), group_limit)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """``id_col``, ``fp`` (signed long) and ``component_id`` (smallest id reachable over links) of every row."""
    prints = Table(with_fingerprint(docs.select(id_col, text_col), text_col, words=words))
    classes = prints.df.groupBy("fp").agg(F.min(id_col).alias("low"))
    links = near_links(classes.select("fp"), distance, group_limit)
    roots = components(links).df
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.df.join(rooted.join(lowest, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def near_digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
