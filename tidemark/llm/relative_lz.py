"""Substring deduplication by relative Lempel-Ziv parsing against an index of the whole corpus.

The reference is the corpus itself, cut by content into blocks. Every window of ``window`` words picks
its smallest word group as anchor; the consecutive windows with the same anchor are a block, and the
words they cover its content. Equal windows pick equal anchors, so a repeat can only lie in blocks
whose anchor stands elsewhere too. The index holds, for each anchor that does, whether all its blocks are
equal, and the first and the last place (text and word) where it stands.

A document is parsed greedily against that index. A block whose anchor repeats with one and the same
content starts a factor at the block's indexed place (the last one, if it is the first itself); the factor
goes on as long as the next block stands right behind it in the document and, at the same distance, in
the same indexed text. Such factors (``factors``) have ``window`` words or more, and all their words are
duplicates. At factor ends, where an anchor repeats with differing content, the block's windows
are checked one by one: distinct blocks are brought together by anchor, and a window counts if its words
stand in two of them or in a block that itself occurs twice. The decisions are those of comparing all
windows of all documents with each other, but one row per block (about every fifteenth word) moves
instead of one per word.

Shuffles: the anchors, pre-aggregated; the repeating blocks; the texts once, to meet their spans. Bloom
filters of fixed size (``bits``) keep blocks that cannot repeat from moving; a full filter only lets
more through, as the join behind it is exact. A passage in a third of the documents is one aggregated
row in the index and a skewed side of an outer join, which adaptive execution splits. Blocks and words
are compared by 64-bit hashes of two kinds at a time (128 bits).

Words are runs of other than ASCII white space. Null and short texts have no windows and stay whole.
Repeated rows are repeats of each other. An empty table gives an empty result. ``docs`` must be a
repeatable plan such as a table scan, as rows are numbered by their place in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe_trie import slices
from tidemark.llm.tables import Table, unused

WINDOW, GROUP = 35, 8
#: log2 of the bits of each Bloom filter (8 MB), and hash places per entry.
BITS, PLACES = 26, 3

_U = np.uint64
_R = _U(0x9E3779B97F4A7C15)
_R_INVERSE = _U(pow(int(_R), -1, 1 << 64))


class Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, as far as they are needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, r in (("up", _R), ("down", _R_INVERSE)):
                steps = np.full(size, r, _U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=_U))


_POWERS = Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value over all others."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Blocks:
    """Anchor blocks of one document: for each, its anchor, content hash, first window and windows."""

    __slots__ = ("anchor", "content", "first", "count", "windows")

    def __init__(self, words: list[bytes], window: int = WINDOW, group: int = GROUP):
        n = len(words)
        starts = n - window + 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), _U, n)
        _POWERS.reach(n + 1)
        up, down = _POWERS.up, _POWERS.down
        sums = np.zeros(n + 1, _U)
        np.cumsum(hashes * down[:n], dtype=_U, out=sums[1:])
        grams = _mixed((sums[group:] - sums[:-group]) * up[: n - group + 1] ^ _U(0x5851F42D4C957F2D))
        self.windows = _mixed((sums[window:] - sums[:-window]) * up[:starts])
        at = _first_minima(grams, window - group + 1)
        edge = np.flatnonzero(at[1:] != at[:-1]) + 1
        self.first = np.concatenate([[0], edge])
        end = np.concatenate([edge, [starts]])
        self.count = end - self.first
        self.anchor = grams[at[self.first]]
        self.content = _mixed((sums[end - 1 + window] - sums[self.first]) * up[self.first] + self.count.astype(_U))


def _first_minima(x: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` values, the place of its first smallest."""
    best, place, have = x, np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        left, right = slice(0, len(best) - step), slice(step, len(best))
        later = best[right] < best[left]
        place = np.where(later, place[right], place[left])
        best = np.where(later, best[right], best[left])
        have += step
    return place


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _places(bits: int) -> list[int]:
    """Shifts that cut an anchor's places in the filter out of its bits."""
    return [(64 - bits) * i // (PLACES - 1) for i in range(PLACES)]


def bloom_bits(hashes: DataFrame, name: str, bits: int) -> np.ndarray:
    """Bit set of a Bloom filter over a column of hashes; at most 2**bits / 64 rows of it come to the driver."""
    places = [F.shiftrightunsigned(name, s).bitwiseAND((1 << bits) - 1) for s in _places(bits)]
    words = hashes.select(F.explode(F.array(*places)).alias("p")).select(F.shiftright("p", 6).alias("w"), _bit(F.col("p").bitwiseAND(63)).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), _U)
    out[got["w"].to_numpy()] = got["b"].to_numpy().view(_U)
    return out


def in_bloom(bloom: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for s in _places(bits):
        p = (hashes >> _U(s)) & _U((1 << bits) - 1)
        hit &= (bloom[(p >> _U(6)).astype(np.int64)] >> (p & _U(63))) & _U(1) == 1
    return hit


def _index(texts: DataFrame, window: int, group: int) -> DataFrame:
    """Anchors that occur twice or more, whether their blocks differ, and the first and last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(1).to_numpy()
            for start, some in slices(batch.column(0)):
                found = [(numbers[k], Blocks(w, window, group)) for k, w in enumerate(map(_words, some), start) if len(w) >= window]
                if found:
                    cols = [np.concatenate(c) for c in zip(*((b.anchor.view(np.int64), b.content.view(np.int64), np.full(len(b.first), n), b.first) for n, b in found))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "content", "row", "first"])

    rows = texts.mapInArrow(run, "anchor bigint, content bigint, row bigint, first bigint")
    seen = rows.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.min(F.struct("row", "first")).alias("one"), F.max(F.struct("row", "first")).alias("other")
    )
    return seen.filter("n > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("differ"), "one", "other")


def _parsed(texts: DataFrame, window: int, group: int, bits: int) -> DataFrame:
    """Blocks (row, first, count, anchor, content, differ, one, other, and windows if they differ) whose anchor repeats, written."""
    if not 0 < group < window or window - group + 1 > 63:
        raise ValueError("a window must be longer than a word group, by 62 at most")
    spark = texts.sparkSession
    index = Table(_index(texts.select("text", "row"), window, group)).df
    same, differ = (spark.sparkContext.broadcast(bloom_bits(index.filter(c), "anchor", bits)) for c in ("NOT differ", "differ"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(1).to_numpy()
            for start, some in slices(batch.column(0)):
                for k, words in enumerate(map(_words, some), start):
                    if len(words) < window:
                        continue
                    b = Blocks(words, window, group)
                    open_ = in_bloom(differ.value, b.anchor, bits)
                    take = np.flatnonzero(open_ | in_bloom(same.value, b.anchor, bits))
                    if not len(take):
                        continue
                    lists = [b.windows[f : f + c].view(np.int64) if o else None for f, c, o in zip(b.first[take], b.count[take], open_[take])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(take), numbers[k])),
                            pa.array(b.first[take]),
                            pa.array(b.count[take]),
                            _signed(b.anchor[take]),
                            _signed(b.content[take]),
                            pa.array(lists, pa.list_(pa.int64())),
                        ],
                        names=["row", "first", "count", "anchor", "content", "windows"],
                    )

    blocks = texts.select("text", "row").mapInArrow(run, "row bigint, first bigint, count bigint, anchor bigint, content bigint, windows array<bigint>")
    return Table(blocks.join(index, "anchor").withColumn("windows", F.when(F.col("differ"), F.col("windows")))).df


def _factors(parsed: DataFrame, window: int) -> DataFrame:
    """(row, first, words, ref_row, ref_first): runs of repeated blocks that stand in one indexed text at one distance."""
    same = parsed.filter("NOT differ")
    place = F.when((F.col("one.row") == F.col("row")) & (F.col("one.first") == F.col("first")), F.col("other")).otherwise(F.col("one"))
    blocks = same.select("row", "first", "count", place.alias("at")).select("row", "first", "count", F.col("at.row").alias("ref_row"), F.col("at.first").alias("ref_first"))
    order = Window.partitionBy("row").orderBy("first")
    shift = F.col("ref_first") - F.col("first")
    goes_on = (
        (F.lag(F.col("first") + F.col("count")).over(order) == F.col("first"))
        & (F.lag("ref_row").over(order) == F.col("ref_row"))
        & (F.lag(shift).over(order) == shift)
    )
    numbered = blocks.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("factor", F.sum("new").over(order))
    whole = numbered.groupBy("row", "factor").agg(
        F.min("first").alias("first"), (F.max(F.col("first") + F.col("count")) - F.min("first") + (window - 1)).alias("words"), F.first("ref_row").alias("ref_row"), F.min("ref_first").alias("ref_first")
    )
    return whole.drop("factor")


def factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group: int = GROUP, bits: int = BITS) -> DataFrame:
    """Factors of every document: ``id_col``, first (its word), words, and where they stand too: ref_id, ref_first.

    A text's factors may share words at their ends, as blocks do. Rows of one id are told apart by the
    reference, not in the result.
    """
    numbered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    found = _factors(_parsed(numbered.select("text", "row"), window, group, bits), window)
    own, other = numbered.select("row", F.col("id").alias(id_col)), numbered.select(F.col("row").alias("ref_row"), F.col("id").alias("ref_id"))
    return found.join(own, "row").join(other, "ref_row").select(id_col, "first", "words", "ref_id", "ref_first")


def repeated_windows(texts: DataFrame, window: int = WINDOW, group: int = GROUP, bits: int = BITS) -> DataFrame:
    """(row, first, mask, count): windows that stand elsewhere too: of those from ``first`` on, those whose bit is set, or the first ``count``.

    ``texts`` has the columns text and row. A block has at most ``window - group + 1`` windows, which
    must fit into a long; a factor has any number and no mask.
    """
    found = _parsed(texts, window, group, bits)
    none = F.lit(None).cast("long")
    whole = _factors(found, window).select("row", "first", none.alias("mask"), (F.col("words") - (window - 1)).alias("count"))

    edges = found.filter("differ")
    distinct = edges.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.first("windows").alias("windows"))
    single = distinct.select("anchor", "content", "n", F.posexplode("windows").alias("i", "w"))
    twice = single.groupBy("anchor", "w").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", "w")
    masks = single.join(twice, ["anchor", "w"], "left_semi").groupBy("anchor", "content").agg(F.bit_or(_bit(F.col("i"))).alias("mask"))
    # Written, so that both sides of the next join are exchanges and a block that stands everywhere can be split.
    masks = Table(masks).df
    parts = edges.select("row", "first", "anchor", "content").join(masks, ["anchor", "content"]).select("row", "first", "mask", none.alias("count"))
    return whole.unionByName(parts)


def _covered(n: int, spans: list[dict], window: int) -> np.ndarray:
    """Which of ``n`` words a marked window covers."""
    edges = np.zeros(n + 1, np.int64)
    for s in spans:
        mask, at = s["mask"], s["first"]
        if mask is None:
            edges[at] += 1
            edges[at + s["count"] - 1 + window] -= 1
            continue
        while mask:
            skip = (mask & -mask).bit_length() - 1
            mask >>= skip
            at += skip
            run = (~mask & (mask + 1)).bit_length() - 1
            edges[at] += 1
            edges[at + run - 1 + window] -= 1
            mask >>= run
            at += run
    return np.cumsum(edges[:n]) > 0


def mark_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, group: int = GROUP, bits: int = BITS) -> DataFrame:
    """``docs`` and a last column (null or a list of first, mask, count): its windows that stand elsewhere too."""
    row = unused("_row", docs)
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    marks = repeated_windows(numbered.select(F.col(text_col).alias("text"), F.col(row).alias("row")), window, group, bits)
    spans = marks.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("first", "mask", "count")).alias(unused("_spans", docs)))
    return numbered.join(spans, row, "left").drop(row)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_col``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            total: list[int] = []
            removed: list[int] = []
            sha: list[str] = []
            for start, some in slices(batch.column(1)):
                for k, words in enumerate(map(_words, some), start):
                    kept = words
                    if found := spans[k].as_py():
                        gone = _covered(len(words), found, window)
                        kept = [w for w, g in zip(words, gone.tolist()) if not g]
                    total.append(len(words))
                    removed.append(len(words) - len(kept))
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=[id_col, "n_words", "n_removed", "kept_sha256"]
            )

    marked = mark_repeats(docs.select(id_col, text_col), text_col, window)
    kind = marked.schema[id_col].dataType.simpleString()
    return marked.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without its repeated words; texts without repeats stay as they are, others get single spaces."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot, spans = batch.schema.names.index(text_col), batch.column(batch.num_columns - 1)
            out: list[str | None] = []
            for start, some in slices(batch.column(spot)):
                for k, text in enumerate(some, start):
                    if found := spans[k].as_py():
                        words = _words(text)
                        gone = _covered(len(words), found, window)
                        text = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "surrogatepass")
                    out.append(text)
            cols = [pa.array(out, pa.string()) if i == spot else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return mark_repeats(docs, text_col, window).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
