"""Ranked lexical search: Block-Max MaxScore over an inverted index in shards.

``build_index`` cuts the documents into shards of bounded text, without a shuffle, and writes one row per
block of up to 128 postings of a term: compressed document places and frequencies, and beside them the
block's peaks, the (frequency, length) pairs that no other pair of the block beats. A score grows with
the frequency and falls with the document's length, so peaks give the block's largest score exactly,
whatever the weights are. A header row per shard holds its ids and lengths.

``search`` takes queries in packs of bounded size. Document frequencies come from the index's counts,
so a term's weight covers all documents. The postings of a pack's terms meet by shard. There each
query's lists are taken in order of their largest score; as soon as the largest scores of the lists to
come cannot lift a new document over the tenth score so far, these lists are no longer essential. From
then on no document enters; for those that have, the largest score of the block in which a document
would stand rejects it before that block is decompressed. A task keeps one heap per query from shard to
shard, and the heaps of all tasks are merged at the end.

Terms are runs of ASCII letters and digits and of other than ASCII characters, A-Z in lower case. Null,
empty and termless texts are in no list. Equal scores are ordered by id (null ids last), then by place
in the index. Rows stored twice are documents of their own. A very long text is a shard of its own. An
empty table, or no query with a known term, gives no rows. Other columns are not read. Ids are whole numbers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import Table

#: Postings per block; bytes of text per shard; bytes of terms in a pack of queries.
BLOCK, SHARD, PACK = 128, 24_000_000, 4_000_000
_STEP = 2_000_000
_LAST = np.iinfo(np.int64).max
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = "shard string, term string, n bigint, first int, last int, peaks binary, postings binary, ids array<bigint>"


def terms(text: str | bytes | None) -> list[bytes]:
    """Terms of a text in order, repeats included, in UTF-8."""
    return (text.encode() if isinstance(text, str) else text or b"").translate(_FOLD).split()


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of seven bits a number (the last one of a number under 128), and where each number starts."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        low = (values[has] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[start[has] + k] = low | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, start


def unpack_numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + k <= ends
        out[has] |= (raw[starts[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


def _binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([starts, [len(data)]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class ShardWriter:
    """Collects documents of one shard and gives its index rows."""

    def __init__(self):
        self.size = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.found: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self._terms: list[bytes] = []
        self._tf: list[int] = []
        self._own: list[tuple[int, int]] = []
        self._held = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        words = terms(text)
        if not words:
            return
        counts = Counter(words)
        self._own.append((len(self.ids), len(counts)))
        self._terms.extend(counts)
        self._tf.extend(counts.values())
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.size += len(text)
        self._held += len(text)
        if self._held >= _STEP:
            self._fold()

    def _fold(self) -> None:
        if self._terms:
            own = np.array(self._own)
            self.found.append((pa.array(self._terms, pa.binary()), np.repeat(own[:, 0], own[:, 1]).astype(np.int32), np.array(self._tf, np.int32)))
        self._terms, self._tf, self._own, self._held = [], [], [], 0

    def rows(self, shard: str) -> Iterator[pa.RecordBatch]:
        self._fold()
        if not self.found:
            return
        coded = pa.chunked_array([f[0] for f in self.found]).dictionary_encode().unify_dictionaries()
        names = coded.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        doc, tf = (np.concatenate([f[k] for f in self.found]) for k in (1, 2))
        self.found = []
        order = np.argsort(code, kind="stable")  # documents came in order of their place
        code, doc, tf = code[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
        lengths = np.array(self.lengths, np.int64)
        new = np.concatenate([[True], code[1:] != code[:-1]])
        begin = np.flatnonzero(new)
        spot = np.arange(len(code)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(code)]])))
        first = np.flatnonzero(spot % BLOCK == 0)
        count = np.diff(np.concatenate([first, [len(code)]]))
        block = np.repeat(np.arange(len(first)), count)
        gap = np.diff(doc, prepend=0)
        gap[first] = 0  # a block starts from its own first place
        data, start = pack_numbers(np.stack([gap, tf], axis=1).ravel())
        # Peaks: by rising length, each frequency above all before it in the block.
        size = lengths[doc]
        by = np.lexsort((-tf, size, block))
        lift = block[by] * np.int64(1 << 40) + tf[by]
        peak = by[np.concatenate([[True], lift[1:] > np.maximum.accumulate(lift)[:-1]])]
        marks, mark = pack_numbers(np.stack([tf[peak], size[peak]], axis=1).ravel())
        per = np.searchsorted(block[peak], np.arange(len(first)))
        header = [[shard], pa.array([""]), pa.array([len(lengths)], pa.int64()), pa.array([0], pa.int32()), pa.array([0], pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(header[0]), *header[1:], pa.array([b""], pa.binary()), _binary(pack_numbers(lengths)[0], np.array([0])), pa.array([self.ids], pa.list_(pa.int64()))], names=_NAMES)
        text = names.take(pa.array(code[first])).cast(pa.string())
        whole = pa.RecordBatch.from_arrays(
            [pa.array([shard] * len(first)), text, pa.array(count.astype(np.int64)), pa.array(doc[first].astype(np.int32)), pa.array(doc[first + count - 1].astype(np.int32)),
             _binary(marks, mark[2 * per]), _binary(data, start[2 * first]), pa.nulls(len(first), pa.list_(pa.int64()))],
            names=_NAMES,
        )
        yield from (whole.slice(i, 20_000) for i in range(0, len(first), 20_000))


_NAMES = ["shard", "term", "n", "first", "last", "peaks", "postings", "ids"]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD) -> Table:
    """The index as a written table; the caller drops it when no search reads it any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, shard = TaskContext.get().partitionId(), 0, ShardWriter()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                shard.add(doc_id, texts[i].as_py())
                if shard.size >= shard_bytes:
                    yield from shard.rows(f"{part}-{k}")
                    k, shard = k + 1, ShardWriter()
        yield from shard.rows(f"{part}-{k}")

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return Table(src.mapInArrow(run, INDEX))


class Scorer:
    """Scores of a collection: ``documents`` with terms, ``length`` terms in all."""

    def __init__(self, documents: int, length: int):
        self.documents, self.length = documents, length

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def share(self, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What a term of weight 1 adds for its frequency in a document of ``size`` terms."""
        m = 25 + (75 * size * self.documents) // self.length
        return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Postings:
    """One term's blocks in a shard; a block is decompressed when first asked for."""

    def __init__(self, rows: list[tuple], lengths: np.ndarray, scorer: Scorer):
        rows.sort(key=lambda r: r[0])
        self.first, self.last = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self._rows, self._lengths, self._scorer = rows, lengths, scorer
        peaks = [unpack_numbers(r[2]).reshape(-1, 2) for r in rows]
        shares = scorer.share(*np.concatenate(peaks).T)
        self.most = np.maximum.reduceat(shares, np.cumsum([0, *map(len, peaks)])[:-1])
        self.top = int(self.most.max())
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._all: tuple[np.ndarray, np.ndarray] | None = None

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and shares of a block."""
        if k not in self._open:
            gap, tf = unpack_numbers(self._rows[k][3]).reshape(-1, 2).T
            doc = int(self.first[k]) + np.cumsum(gap)
            self._open[k] = doc, self._scorer.share(tf, self._lengths[doc])
        return self._open[k]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        if self._all is None:
            got = [self.block(k) for k in range(len(self.first))]
            docs, shares = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
            self._all = docs[shares > 0], shares[shares > 0]
        return self._all

    def blocks_of(self, docs: np.ndarray) -> np.ndarray:
        """Number of the block in whose span each place lies, or -1."""
        k = np.searchsorted(self.last, docs)
        inside = k < len(self.first)
        inside[inside] = self.first[k[inside]] <= docs[inside]
        return np.where(inside, k, -1)


def _tenth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


class ShardSearch:
    """A shard's lists; ``opened`` counts the blocks that were decompressed."""

    def __init__(self, ids: np.ndarray, lists: dict[str, Postings]):
        self.ids, self.lists = ids, lists
        self._sums = np.zeros(len(ids), np.int64)

    @property
    def opened(self) -> int:
        return sum(len(p._open) for p in self.lists.values())

    def best(self, query: list[tuple[str, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that can be among the best ``k``; ``floor``: a score that ``k`` others have reached."""
        lists = [(self.lists[t], w) for t, w in query if t in self.lists and w > 0]
        lists.sort(key=lambda x: -x[0].top * x[1])
        ahead = np.cumsum([0, *[p.top * w for p, w in reversed(lists)]])[::-1]  # most that lists i.. can add
        sums, seen, i = self._sums, [], 0
        least = max(floor, 1)
        docs = np.zeros(0, np.int64)
        # Essential lists: while documents not yet seen can still reach the floor.
        while i < len(lists) and ahead[i] >= least:
            p, w = lists[i]
            at, share = p.whole()
            seen.append(at[sums[at] == 0])
            sums[at] += share * w
            i += 1
            docs = np.concatenate(seen)
            least = max(least, _tenth(sums[docs], k))
        got = sums[docs]
        sums[docs] = 0
        # The others: only seen documents, and only blocks whose largest score may matter.
        for p, w in lists[i:]:
            i += 1
            at = p.blocks_of(docs)
            most = got + np.where(at >= 0, p.most[at] * w, 0) + ahead[i]
            alive = most >= least
            docs, got, at = docs[alive], got[alive], at[alive]
            inside = np.flatnonzero(at >= 0)
            inside = inside[np.argsort(at[inside], kind="stable")]
            own, start = np.unique(at[inside], return_index=True)
            for b, some in zip(own.tolist(), np.split(inside, start[1:])):
                there, share = p.block(b)
                spot = np.minimum(np.searchsorted(there, docs[some]), len(there) - 1)
                got[some] += np.where(there[spot] == docs[some], share[spot] * w, 0)
            least = max(least, _tenth(got, k))
        return docs[got >= least], got[got >= least]


def _searched(index: DataFrame, weights: dict[str, int], queries: list[list[tuple[str, int]]], scorer: Scorer, k: int) -> DataFrame:
    """(q, score, id, shard, place): each task's best ``k`` of every query, over the rows of whole shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int, str, int]]] = [[] for _ in queries]

        def finish(name: str, ids: np.ndarray, lengths: np.ndarray, rows: dict[str, list[tuple]]) -> None:
            if not rows:
                return
            shard = ShardSearch(ids, {t: Postings(r, lengths, scorer) for t, r in rows.items()})
            for q, query in enumerate(queries):
                heap = heaps[q]
                docs, scores = shard.best(query, k, -heap[-1][0] if len(heap) == k else 0)
                if len(docs):
                    some = np.lexsort((docs, ids[docs], -scores))[:k]
                    new = [(-s, i, name, d) for s, i, d in zip(scores[some].tolist(), ids[docs[some]].tolist(), docs[some].tolist())]
                    heaps[q] = sorted([*heap, *new])[:k]

        name, ids, lengths, rows = None, None, None, {}
        for batch in batches:
            for shard, term, first, last, peaks, postings, own in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != name:
                    if name is not None:
                        finish(name, ids, lengths, rows)
                    name, rows = shard, {}
                if term == "":
                    ids, lengths = np.array([_LAST if i is None else i for i in own], np.int64), unpack_numbers(postings)
                else:
                    rows.setdefault(term, []).append((first, last, peaks, postings))
        if name is not None:
            finish(name, ids, lengths, rows)
        flat = [(q, -s, None if i == _LAST else i, n, d) for q, heap in enumerate(heaps) for s, i, n, d in heap]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in flat], t) for c, t in enumerate(kinds)], names=["q", "score", "id", "shard", "place"])

    spark = index.sparkSession
    wanted = spark.createDataFrame([(t,) for t in ["", *weights]], "term string")
    # At most PACK bytes of terms, or those of one query.
    rows = index.join(F.broadcast(wanted), "term").select("shard", "term", "first", "last", "peaks", "postings", "ids")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "term")
    return rows.mapInArrow(run, "q int, score bigint, id bigint, shard string, place int")


def packs(queries: DataFrame, pack_bytes: int = PACK) -> Iterator[list[tuple[int, Counter]]]:
    """Queries (a number n and a text) with their terms, so many at a time that terms stay under ``pack_bytes``; a larger query comes alone."""
    pack, held = [], 0
    for r in queries.toLocalIterator():
        found = Counter(t.decode() for t in terms(r.text))
        size = sum(map(len, found)) + 64
        if pack and held + size > pack_bytes:
            yield pack
            pack, held = [], 0
        pack.append((r.n, found))
        held += size
    if pack:
        yield pack


def search(index: Table, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", pack_bytes: int = PACK) -> DataFrame:
    """``id_col``, rank, ``doc_col``, score: the best ``k`` documents of every query with a score above 0."""
    spark = queries.sparkSession
    totals = index.df.filter("term = ''").select("n", "postings").mapInArrow(_lengths, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    kind = queries.schema[id_col].dataType.simpleString()
    scorer = Scorer(totals[0] or 0, totals[1] or 0)
    numbered = Table(queries.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")).withColumn("n", F.monotonically_increasing_id()))
    out: list[DataFrame] = []
    for pack in packs(numbered.df.select("n", "text"), pack_bytes) if scorer.documents else ():
        known = sorted({t for _, found in pack for t in found})
        wanted = spark.createDataFrame([(t,) for t in known], "term string")
        df = dict(index.df.select("term", "n").join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("n")).collect()) if known else {}
        weights = {t: w for t, d in df.items() if (w := scorer.weight(d)) > 0}
        if not weights:
            continue
        texts = [[(t, weights[t] * c) for t, c in sorted(found.items()) if t in weights] for _, found in pack]
        got = _searched(index.df, weights, texts, scorer, k)
        names = spark.createDataFrame([(q, n) for q, (n, _) in enumerate(pack)], "q int, n bigint")
        by = Window.partitionBy("q").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "shard", "place")
        best = got.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        out.append(Table(best.join(F.broadcast(names), "q").select("n", "rank", "id", "score")).df)
    if not out:
        return spark.createDataFrame([], f"`{id_col}` {kind}, rank int, `{doc_col}` bigint, score bigint")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return numbered.df.select("n", "item").join(found, "n").select(F.col("item").alias(id_col), "rank", F.col("id").alias(doc_col), "score")


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total = [int(unpack_numbers(x).sum()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64())], names=["n", "total"])


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index ``documents`` and search it for every item of ``benchmark``."""
    index = build_index(docs)
    found = Table(search(index, queries, k))
    index.drop()
    return found.df
