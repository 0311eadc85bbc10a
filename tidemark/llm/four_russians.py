"""Hard negatives for embedding training, with exact integer scores by the Four-Russians method.

A component x counts as floor(256 x). Candidates are stored in blocks as bit planes: for each binary
place of their components (two's complement), one byte per group of eight dimensions. For an anchor,
each group has a table of the 256 sums over subsets of its eight components; a candidate's byte is the
index into it. The lookups of one plane add up to that plane's inner product, and the planes are shifted
and added, the sign's plane with a minus: the full exact score, without a multiplication.

Anchors come in packs of bounded size; a pack goes to all tasks and meets the stored blocks twice. The
first pass finds each anchor's best rows of its own label, the positives; the second its best rows of
other labels within the window below each positive's score. A task keeps only the best ``k`` of
each anchor (or window), so no set of pairs is sent out; the tasks' rows meet by anchor.

Rows with a null label, a null vector, a null or non-finite component, or one of 65,536 or more in size
(sums might pass 64 bits) take no part. Vectors are compared with those of their own length. Equal
scores are ordered by id, null ids last. Rows stored twice are rows of their own: a copy can be its
anchor's positive. Too few rows give fewer results, an empty table none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import Table

#: Bytes of anchors in a pack; candidates in a stored block; anchors whose tables are held at a time.
PACK, BLOCK, TILE = 4_000_000, 2048, 64
SCALE, LARGEST = 256, 1 << 16
_LAST = np.iinfo(np.int64).max
_NEVER = np.iinfo(np.int64).min


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Packed bits of whole numbers (rows by dimensions): planes, groups of eight dimensions, rows; the sign's plane first."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    planes = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    out = [np.packbits((values >> b) & 1, axis=1, bitorder="little").T for b in reversed(range(planes))]
    return np.ascontiguousarray(np.stack(out).astype(np.uint8))


def subset_tables(anchors: np.ndarray) -> np.ndarray:
    """Sums over the subsets of each group of eight dimensions: groups, 256 subsets, anchors."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    part = np.zeros((groups, 8, n), np.int64)
    part.reshape(groups * 8, n)[:dims] = anchors.T
    out = np.zeros((groups, 256, n), np.int64)
    for bit in range(8):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + part[:, bit : bit + 1]
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products, candidates by anchors, of packed candidates with the tables' anchors."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for k, plane in enumerate(planes):
        if k == 1:
            np.negative(total, out=total)  # what stands there is the sign's plane
        total <<= 1
        for table, codes in zip(tables, plane):
            total += table.take(codes, axis=0)
    return -total if len(planes) == 1 else total


def fitting(anchors: np.ndarray, planes: int) -> type:
    """The smallest type that holds every score against ``planes`` bit planes."""
    most = int(np.abs(anchors).sum(axis=1).max(initial=0)) << planes
    return np.int32 if most < 1 << 31 else np.int64


@dataclass
class Anchors:
    """A pack of anchors of one length."""

    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def tiles(self, size: int) -> Iterator[slice]:
        return (slice(i, min(i + size, len(self.rows))) for i in range(0, len(self.rows), size))


class Best:
    """The best ``k`` of each key by (score, least id), from batches of (key, score, id)."""

    def __init__(self, keys: int, k: int):
        self.k, self.floor = k, np.full(keys, _NEVER)
        self.key = self.score = self.id = np.zeros(0, np.int64)
        self._later: list[tuple[np.ndarray, ...]] = []
        self._held = 0

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self._later.append((key, score, ids))
        self._held += len(key)
        if self._held >= 4 * self.k * len(self.floor) + 1000:
            self.settle()

    def settle(self) -> None:
        key, score, ids = (np.concatenate(x) for x in zip((self.key, self.score, self.id), *self._later))
        order = np.lexsort((ids, -score, key))
        key = key[order]
        start = np.searchsorted(key, key)
        rank = np.arange(len(key)) - start
        keep = order[rank < self.k]
        last = rank == self.k - 1
        self.floor[key[last]] = score[order[last]]
        self.key, self.score, self.id = (x[keep] for x in (np.concatenate(y) for y in zip((self.key, self.score, self.id), *self._later)))
        self._later, self._held = [], 0


def stored(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> Table:
    """Usable rows in blocks (dims, rows, ids, labels, planes, and the whole numbers of anchors' own rows).

    ``row`` numbers are unique over the table; ``wanted`` marks anchors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, block):
                part = batch.slice(cut, block)
                vectors = part.column(2)
                lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
                flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ends = np.cumsum(lengths)
                meta = [part.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3)]
                for dims in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == dims)
                    at = (ends[own] - dims)[:, None] + np.arange(dims)
                    whole = np.floor(SCALE * flat[at]).astype(np.int64)
                    planes = bit_planes(whole)
                    asked = part.column(4).take(pa.array(own)).to_numpy(zero_copy_only=False).astype(bool)
                    row, ids, labels = (m[own] for m in meta)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dims]), pa.array([len(planes)])]
                        + [pa.array([x], pa.list_(pa.int64())) for x in (row, ids, labels)]
                        + [pa.array([planes.tobytes()], pa.binary())]
                        + [pa.array([x], pa.list_(pa.int64())) for x in (row[asked], ids[asked], labels[asked])]
                        + [pa.array([whole[asked].astype("<i8").tobytes()], pa.binary())],
                        names=names,
                    )

    names = ["dims", "planes", "rows", "ids", "labels", "codes", "a_rows", "a_ids", "a_labels", "a_values"]
    lists = ("rows", "ids", "labels", "a_rows", "a_ids", "a_labels")
    schema = ", ".join(f"{n} " + ("bigint" if n in ("dims", "planes") else "array<bigint>" if n in lists else "binary") for n in names)
    e = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    i = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    src = rows.filter(usable).select(F.monotonically_increasing_id().alias("row"), i.alias("id"), e.alias("e"), F.col(label_col).cast("long").alias("label"), F.coalesce(F.col("_wanted"), F.lit(False)).alias("wanted"))
    return Table(src.mapInArrow(run, schema))


def anchor_packs(blocks: DataFrame, pack_bytes: int = PACK) -> Iterator[Anchors]:
    """Anchors of one length, so many at a time that their vectors stay under ``pack_bytes``."""
    held: dict[int, list[tuple]] = {}
    for r in blocks.filter(F.size("a_rows") > 0).select("dims", "a_rows", "a_ids", "a_labels", "a_values").toLocalIterator():
        own = held.setdefault(r.dims, [])
        own.append((r.a_rows, r.a_ids, r.a_labels, np.frombuffer(r.a_values, "<i8").reshape(len(r.a_rows), r.dims)))
        if sum(len(x[0]) for x in own) * max(1, r.dims) * 8 >= pack_bytes:
            yield _pack(held.pop(r.dims))
    for own in held.values():
        yield _pack(own)


def _pack(own: list[tuple]) -> Anchors:
    rows, ids, labels = (np.concatenate([np.array(x[k], np.int64) for x in own]) for k in range(3))
    return Anchors(rows, ids, labels, np.concatenate([x[3] for x in own]))


def _scanned(blocks: DataFrame, pack: Anchors, keys: int, k: int, find) -> DataFrame:
    """(key, score, id): each task's best ``k`` of every key. ``find(tile, scores, labels, rows, floor)`` gives (key, candidate, score)."""
    dims = pack.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(keys, k)
        for batch in batches:
            for i in range(batch.num_rows):
                n, rows, ids, labels, codes = (batch.column(c)[i] for c in range(5))
                rows, ids, labels = (x.values.to_numpy() for x in (rows, ids, labels))
                planes = np.frombuffer(codes.as_buffer(), np.uint8).reshape(n.as_py(), -1, len(rows))
                for tile in pack.tiles(TILE):
                    kind = fitting(pack.vectors[tile], len(planes))
                    found = scores(subset_tables(pack.vectors[tile]).astype(kind), planes)
                    key, at, score = find(tile, found, labels, rows, best.floor)
                    best.add(key, score.astype(np.int64), ids[at])
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (best.key, best.score, best.id)], names=["key", "score", "id"])

    src = blocks.filter(F.col("dims") == dims).select("planes", "rows", "ids", "labels", "codes")
    by = Window.partitionBy("key").orderBy(F.desc("score"), "id")
    found = src.mapInArrow(run, "key bigint, score bigint, id bigint")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _positives(pack: Anchors):
    def find(tile: slice, found: np.ndarray, labels: np.ndarray, rows: np.ndarray, floor: np.ndarray):
        good = (found >= floor[tile]) & (labels[:, None] == pack.labels[tile]) & (rows[:, None] != pack.rows[tile])
        at, key = np.nonzero(good)
        return key + tile.start, at, found[at, key]

    return find


def _negatives(pack: Anchors, tops: np.ndarray, least: np.ndarray, k: int):
    """``tops`` and ``least``: scores at which the window of each anchor's positives ends and begins (anchors by ``k``), an empty window where there is none."""

    def find(tile: slice, found: np.ndarray, labels: np.ndarray, rows: np.ndarray, floor: np.ndarray):
        low = np.maximum(least[tile], floor.reshape(-1, k)[tile])
        good = (found >= low.min(axis=1)) & (found <= tops[tile].max(axis=1)) & (labels[:, None] != pack.labels[tile])
        at, own = np.nonzero(good)
        score = found[at, own].astype(np.int64)
        inside = (score[:, None] >= low[own]) & (score[:, None] <= tops[tile][own])
        which, j = np.nonzero(inside)
        return (own[which] + tile.start) * k + j, at[which], score[which]

    return find


def mine(
    rows: DataFrame, wanted, positives: int = 5, negatives: int = 5, least_percent: int = 80, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pack_bytes: int = PACK, block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``wanted`` is the condition that makes a row an anchor. An anchor's positives are its best
    ``positives`` other rows of its label; of rows with other labels, the best ``negatives`` that score at
    most the positive's score and at least ``least_percent`` of it are returned for each.
    """
    spark = rows.sparkSession
    blocks = stored(rows.withColumn("_wanted", wanted).select(id_col, vector_col, label_col, "_wanted"), id_col, vector_col, label_col, block)
    out: list[DataFrame] = []
    for pack in anchor_packs(blocks.df, pack_bytes):
        n = len(pack.rows)
        # At most `positives` rows for each anchor of the pack.
        near = _scanned(blocks.df, pack, n, positives, _positives(pack)).collect()
        tops = np.full((n, positives), _NEVER)
        least = np.full((n, positives), _LAST)
        pairs = []
        for r in near:
            j = r["rank"] - 1
            tops[r.key, j] = r.score
            least[r.key, j] = -(-least_percent * r.score // 100) if r.score >= 0 else _LAST
            pairs.append((r.key * positives + j, int(pack.ids[r.key]), r.id, r.score))
        if not pairs:
            continue
        far = _scanned(blocks.df, pack, n * positives, negatives, _negatives(pack, tops, least, positives))
        named = spark.createDataFrame(pairs, "key bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        got = far.join(F.broadcast(named), "key")
        out.append(Table(got.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))).df)
    blocks.drop()
    if not out:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.withColumns({c: F.when(F.col(c) != _LAST, F.col(c)) for c in ("anchor_id", "positive_id", "negative_id")})


def relabelled(rows: DataFrame) -> DataFrame:
    """Every seventh id gets the next of ten labels, as noise that the search has to live with."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def hard_negatives(rows: DataFrame) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100."""
    return mine(relabelled(rows.select("vec_id", "embedding", "label")), F.col("vec_id") % 100 == 0)
