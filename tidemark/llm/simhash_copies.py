"""Near copies by similarity of word shingles: a wide SimHash finds them, exact sets confirm them.

Four bits in 64, as in ``gray_simhash``, admit only texts that are almost equal. Texts whose sets of
five-word shingles share 0.8 of their union differ in about 0.15 of all fingerprint bits, so this form
takes 256 bits per text and ``DISTANCES`` up to three standard deviations above that. Texts with equal
sets are one class. A class goes to one group for each band, a sample of ``BAND_BITS`` bits or more; two
classes at 0.8 meet in some group with probability 0.98 or so (more if they are closer). Groups are
searched with the Gray-order index of ``gray_simhash``; each sends out the links that span its clusters,
closest first, and a link stays if the exact similarity of its two sets is at least ``similarity``. With
the table, bands get more bits and become more (``bands_for``), so that a group does not grow with it.
Where a link was rejected, what it held together is searched again, with the sets at hand: rows of such a
component are compared in parts of ``PART`` shingles, each row with those of other verified clusters
within the last distance, closest first, and a pair at ``similarity`` merges its clusters at once. Only
links that merge clusters leave a part, never its pairs. Of components with several parts, the rows
outside the largest cluster then meet all parts. Sets are made again in a second pass over the texts,
for linked classes only (a Bloom filter of fixed size picks them).

Bits of small sets vary more, so sets of up to ``SHORT`` shingles are also linked exactly: in an order
of all shingles, rare ones first, two sets at ``similarity`` share one of their first
``n - ceil(similarity * n) + 1``; sets that share one are a group, in which they are compared in full.

Words and empty texts are as in ``gray_simhash``; texts without words are equal. Repeated rows are one
class. A very long text is one task's work, linear in its length; an empty table gives an empty result.
``docs`` must be a repeatable plan such as a table scan, as rows are numbered by their place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_trie import slices
from tidemark.llm.components import components
from tidemark.llm.gray_simhash import GROUP_LIMIT, SEED, _levels, _linked, dealt, near_pairs
from tidemark.llm.relative_lz import bloom_bits, in_bloom
from tidemark.llm.tables import Table, unused

WORDS, SIMILARITY = 5, 0.8
PARTS = 4
DISTANCES = (28, 42, 56)
#: Bands and their bits for tables of up to ``CLASSES`` distinct sets; 16 times as many take four bits more and twice the bands.
BANDS, BAND_BITS, CLASSES = 32, 12, 250_000
#: log2 of the bits of the filter that picks linked classes (1 MB).
BITS = 23
#: Shingles of a part of a component; candidates that are compared at a time.
PART, STEP = 1 << 19, 128
#: Shingles of a short set; log2 of the counters that order shingles; rows of a group of short sets.
SHORT, COUNTERS, SHORT_LIMIT = 32, 18, 8_192
PRINTS = [f"f{i}" for i in range(PARTS)]
#: Equal in texts of equal sets, and in no others.
CLASS = [*PRINTS, "s0", "s1", "size"]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(found) - words + 1
    cut = [joined[a:b] for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, n))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """Bitwise majorities of a set of hashes and of three mixings of it: ``PARTS`` words."""
    out = np.zeros(PARTS, np.uint64)
    x = hashes
    for i in range(PARTS if len(hashes) else 0):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(x), 1 << 16):
            part = x[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out


def bands_for(classes: int) -> tuple[int, int]:
    """Number of bands and bits of each for so many classes: groups stay small, and 0.8 is found as often."""
    k = max(0, math.ceil(math.log(max(classes, 1) / CLASSES, 16)))
    return BANDS << k, BAND_BITS + 4 * k


def band_places(bands: int = BANDS, bits: int = BAND_BITS) -> np.ndarray:
    """The bit positions that each band takes, the same in every run."""
    rng = np.random.default_rng(11)
    return np.stack([rng.choice(64 * PARTS, bits, replace=False) for _ in range(bands)])


def _prints(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    longest = int(SHORT / similarity)
    for batch in batches:
        rows, short = [], []
        for _, texts in slices(batch.column(1)):
            for t in texts:
                h = shingles(t)
                rows.append(np.concatenate([wide_print(h), [h.sum(dtype=np.uint64), np.bitwise_xor.reduce(h), np.uint64(len(h))]]))
                short.append(h.view(np.int64) if 1 < len(h) <= longest else None)
        cols = np.array(rows, np.uint64).reshape(-1, PARTS + 3).T.copy().view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in cols], pa.array(short, pa.list_(pa.int64()))], names=["key", *CLASS, "set"])


def _bands(rows: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """``rows`` (node, fingerprint and other longs) once for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = band_places(*shape)
        for batch in batches:
            prints = np.stack([batch.column(c).to_numpy() for c in range(1, PARTS + 1)]).view(np.uint64)
            for i, band in enumerate(places):
                g = np.full(batch.num_rows, i << shape[1], np.int64)
                for k, place in enumerate(band):
                    g |= ((prints[place // 64] >> np.uint64(place % 64)) & np.uint64(1)).astype(np.int64) << k
                yield pa.RecordBatch.from_arrays([pa.array(g), *batch.columns], names=["g", *batch.schema.names])

    return rows.mapInArrow(run, "g bigint, " + ", ".join(f"{c} bigint" for c in rows.columns))


def spanning_links(prints: np.ndarray, sets: list[np.ndarray], own: np.ndarray, asked: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of clusters (numbers in ``own``) that merge when every row ``asked`` meets all rows of other clusters."""
    sizes = np.array([len(x) for x in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(codes, np.cumsum(sizes)[:-1])
    has = np.zeros(1 + max((int(c.max()) for c in codes if len(c)), default=0), bool)
    label = own.copy()
    out: list[tuple[int, int]] = []
    for i in asked.tolist():
        left = np.flatnonzero(label != label[i])
        left = left[np.minimum(sizes[left], sizes[i]) >= similarity * np.maximum(sizes[left], sizes[i])]
        far = np.bitwise_count(prints[left] ^ prints[i]).sum(axis=1)
        near = far <= DISTANCES[-1]
        left = left[near][np.argsort(far[near], kind="stable")]
        has[codes[i]] = True
        while len(left):
            some, left = left[:STEP], left[STEP:]
            size = sizes[some]
            shared = np.add.reduceat(has[np.concatenate([codes[j] for j in some])].astype(np.int64), np.cumsum(size) - size)
            for other in np.unique(label[some[shared >= similarity * (size + sizes[i] - shared)]]).tolist():
                out.append((int(label[i]), other))
                label[label == other] = label[i]
            left = left[label[left] != label[i]]
        has[codes[i]] = False
    return out


def _merging(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of clusters, from rows (g, asked, own, fingerprint, set) of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def joined() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            sets = t.column("set").combine_chunks()
            flat, ends = sets.flatten().to_numpy(), np.cumsum(sets.value_lengths().to_numpy())
            prints = np.stack([t.column(c).to_numpy() for c in PRINTS], axis=1).view(np.uint64)
            asked = np.flatnonzero(t.column("asked").to_numpy(zero_copy_only=False))
            pairs = spanning_links(prints, np.split(flat, ends[:-1]), t.column("own").to_numpy(), asked, similarity)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(2)], names=["a", "b"])

        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and held[0].column(0)[0].as_py() != g[lo]:
                        yield joined()
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield joined()

    ordered = rows.select("g", "asked", "own", *PRINTS, "set").repartition("g").sortWithinPartitions("g")
    return ordered.mapInArrow(run, "a bigint, b bigint")


def _relabelled(owned: DataFrame, links: DataFrame) -> DataFrame:
    """(node, wide, own) after the clusters in ``links`` have merged."""
    merged = components(links).df.select(F.col("node").alias("own"), "root")
    return Table(owned.join(merged, "own", "left").select("node", "wide", F.coalesce("root", "own").alias("own"))).df


def merged_clusters(owned: DataFrame, rows: DataFrame, sets: DataFrame, similarity: float, part: int = PART) -> DataFrame:
    """(node, wide, own) once more, ``own`` being the clusters of all pairs at ``similarity`` within a component ``wide`` and the last distance.

    ``rows``: node, fingerprint, size of every class; ``sets``: node and set of every node in ``owned``.
    """
    split = owned.groupBy("wide").agg(F.min("own").alias("x"), F.max("own").alias("y")).filter("x <> y").select("wide")
    again = Table(owned.join(split, "wide", "left_semi").join(rows, "node").join(sets, "node")).df
    parts = Table(again.groupBy("wide").agg(F.ceil(F.sum("size") / part).cast("int").alias("k")))
    place = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    inner = again.join(parts.df, "wide").withColumn("asked", F.lit(True)).withColumn("g", F.xxhash64("wide", place("k")))
    owned = _relabelled(owned, Table(_merging(inner, similarity)).df)
    large = parts.df.filter("k > 1")
    if large.isEmpty():
        return owned
    # Rows outside the largest cluster meet all parts of their component.
    now = again.drop("own").join(owned.select("node", "own"), "node").join(large, "wide")
    shares = now.groupBy("wide", "own").agg(F.sum("size").alias("s"))
    main = shares.groupBy("wide").agg(F.max_by("own", "s").alias("main"), F.ceil((F.sum("s") - F.max("s")) / part).cast("int").alias("r")).filter("r > 0")
    keyed = now.join(main, "wide").select("node", "wide", "own", "k", "r", "main")
    rest = keyed.filter("own <> main").select("node", "own", F.lit(True).alias("asked"), "wide", place("r").alias("i"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    every = keyed.select("node", "own", F.lit(False).alias("asked"), "wide", F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("i"), place("k").alias("j"))
    dealt_out = rest.unionByName(every).select("node", "own", "asked", F.xxhash64("wide", "i", "j").alias("g"))
    return _relabelled(owned, Table(_merging(dealt_out.join(again.select("node", *PRINTS, "set"), "node"), similarity)).df)


def exact_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs at ``similarity`` that span the clusters of all such pairs, by a walk from set to set."""
    sizes = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    has = np.zeros(flat.max() + 1, np.int64)
    out: list[tuple[int, int]] = []
    left = np.ones(len(sets), bool)
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            i = queue.pop()
            mine = flat[starts[i] : starts[i] + sizes[i]]
            has[mine] = 1
            shared = np.add.reduceat(has[flat], starts)
            has[mine] = 0
            near = np.flatnonzero(left & (shared >= similarity * (sizes + sizes[i] - shared)))
            left[near] = False
            queue += near.tolist()
            out += [(i, j) for j in near.tolist()]
    return out


def short_links(short: DataFrame, similarity: float, limit: int = SHORT_LIMIT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs at ``similarity``. ``short``: node and set, a repeatable plan of distinct sets."""
    spark, mask = short.sparkSession, np.uint64((1 << COUNTERS) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNTERS, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy().view(np.uint64) & mask, minlength=len(n)) if batch.num_rows else 0
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    seen = np.zeros(1 << COUNTERS, np.int64)
    for r in short.select("set").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
        seen[r["at"]] = r["n"]
    often = spark.sparkContext.broadcast(seen)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, x in zip(batch.column(0).to_numpy(), batch.column(1)):
                h = np.asarray(x.values).view(np.uint64)
                n = often.value[h & mask]
                take = np.lexsort((h, n))[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]
                take = take[n[take] > 1]  # others stand in no second set
                g.append(h[take].view(np.int64))
                node.append(np.full(len(take), at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g)), pa.array(np.concatenate(node))], names=["g", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets = None, [], []
        for batch in batches:
            a, b = [], []
            for g, node, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if g != last:
                    flush(nodes, sets, a, b)
                    last, nodes, sets = g, [], []
                nodes.append(node)
                sets.append(np.array(x.values))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = [], []
        flush(nodes, sets, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def flush(nodes: list[int], sets: list[np.ndarray], a: list[int], b: list[int]) -> None:
        for i, j in exact_links(sets, similarity) if len(sets) > 1 else ():
            a.append(nodes[i])
            b.append(nodes[j])

    rows = Table(short.select("node", "set").mapInArrow(firsts, "g bigint, node bigint")).df
    shared = rows.join(rows.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "g").select("g", "node")
    groups = dealt(shared, [], limit).join(short, "node").select("g", "node", "set")
    return groups.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a bigint, b bigint")


def rooted_classes(numbered: DataFrame, similarity: float = SIMILARITY, group_limit: int = GROUP_LIMIT, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (``CLASS``, low: smallest key, root: a number of their group), and the class of every key.

    ``numbered``: key (a struct with the row number c) and text.
    """
    spark = numbered.sparkSession
    kind = numbered.schema["key"].dataType.simpleString()
    longs = ", ".join(f"{c} bigint" for c in CLASS)
    made = Table(numbered.select("key", "text").mapInArrow(lambda x: _prints(x, similarity), f"key {kind}, {longs}, set array<bigint>")).df
    prints = made.drop("set")
    classes = Table(prints.groupBy(*CLASS).agg(F.min("key").alias("low"))).df
    short = made.filter("set IS NOT NULL").select(F.col("key.c").alias("node"), "set")
    short = Table(short.join(classes.select(F.col("low.c").alias("node")), "node", "left_semi")).df
    rows = classes.select(F.col("low.c").alias("node"), *PRINTS, "size")
    links = _linked(_bands(rows.drop("size"), bands_for(classes.count())), PRINTS, DISTANCES, group_limit)
    pairs = Table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()).df

    nodes = Table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()).df
    picked = spark.sparkContext.broadcast(bloom_bits(nodes.select(F.xxhash64("node").alias("h")), "h", BITS))
    texts = numbered.select(F.col("key.c").alias("node"), F.xxhash64("key.c").alias("h"), "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take = np.flatnonzero(in_bloom(picked.value, batch.column(1).to_numpy().view(np.uint64), BITS))
            if len(take):
                some = batch.take(pa.array(take))
                made = [shingles(t).view(np.int64) for _, part in slices(some.column(2)) for t in part]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "set"])

    known = Table(texts.mapInArrow(sets, "node bigint, set array<bigint>").join(nodes, "node", "left_semi")).df

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.asarray(x.values), np.asarray(y.values)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keep, pa.bool_())], names=["a", "b", "ok"])

    left = pairs.join(known.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(known.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    tried = Table(both.select("a", "b", "x", "y").mapInArrow(alike, "a bigint, b bigint, ok boolean")).df
    good = tried.filter("ok").select("a", "b").unionByName(Table(short_links(short, similarity).distinct()).df)
    roots = components(good).df
    own = rows.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    if not tried.filter("NOT ok").isEmpty():
        wide = components(pairs).df.withColumnRenamed("root", "wide")
        before = Table(wide.join(own, "node").select("node", "wide", F.col("root").alias("own"))).df
        after = merged_clusters(before, rows, known, similarity, part).select("node", F.col("own").alias("now"))
        # Clusters that merged may also hold classes without candidates of their own (short sets).
        moved = before.join(after, "node").select("own", "now").filter("own <> now").distinct()
        merged = components(Table(moved.select(F.col("own").alias("a"), F.col("now").alias("b"))).df).df
        own = own.join(merged.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    return Table(classes.join(own, F.col("low.c") == F.col("node")).select(*CLASS, "low", "root")).df, prints


def copy_groups(numbered: DataFrame, similarity: float = SIMILARITY, group_limit: int = GROUP_LIMIT, part: int = PART) -> DataFrame:
    """(key, first): for each row, the smallest key reachable over links."""
    rooted, prints = rooted_classes(numbered, similarity, group_limit, part)
    first = rooted.groupBy("root").agg(F.min("low").alias("first"))
    return prints.join(rooted.join(first, "root").select(*CLASS, "first"), CLASS).select("key", "first")


def first_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, the first stored among equals, a null id last."""
    row = unused("_row", docs)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    key = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.col(row).alias("c"))
    rooted, _ = rooted_classes(numbered.select(key.alias("key"), F.col(text_col).alias("text")), similarity)
    kept = rooted.groupBy("root").agg(F.min("low").alias("first")).select(F.col("first.c").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
