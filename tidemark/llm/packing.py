"""Packing of documents into training sequences: vector bin packing with cuts.

Every sequence has three limits: tokens, segments and loss-bearing tokens. Each task keeps a pool of
open items (the rest of a document each) and fills one sequence after another: of the items that fit
whole, the one with the greatest dot product of its demands and what is left of the limits (both as
shares of the limits) goes in; when none fits, or only one segment is left, the item that can fill
the most is cut. Whole sequences of a long document leave at once, so the pool holds a bounded number
of short rests. Where the segments run out before the tokens, as with very short documents, a sequence is
the largest power of two that they can fill; so is what remains at the end of a task. Such sequences
need no padding. Only the limit of loss-bearing tokens can leave a sequence unfilled.

Tasks work on their own rows: there is no shuffle, a lost task is simply run again and gives the same
sequences, and no document, source or group of copies can make a task larger than its input split.

Null text counts as empty; a document is its ids and one end mark, so an empty one has one token.
Repeated rows are packed once each; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemark.llm.bpe_trie import slices
from tidemark.llm.byte_ids import byte_tokenizer
from tidemark.llm.vocab import default_path

#: Items a task keeps to choose from.
POOL = 2048


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Item:
    """What is left of a document: its tokens from ``start``; those before ``loss_from`` bear no loss."""

    doc: object
    ids: bytes
    start: int
    total: int
    loss_from: int = 0

    @property
    def tokens(self) -> int:
        return self.total - self.start

    def loss(self, n: int) -> int:
        """Loss-bearing tokens among the next ``n``."""
        return max(0, self.start + n - max(self.start, self.loss_from))

    def most(self, tokens: int, loss: int) -> int:
        """How many of its tokens fit into what is left of a sequence."""
        return min(self.tokens, tokens, max(0, self.loss_from - self.start) + loss)


Piece = tuple[Item, int, int, int, int]  # item, start, length, sequence, offset


@dataclass
class Packer:
    limits: Limits
    pool_size: int = POOL
    items: list[Item] = field(default_factory=list)
    sequence: int = 0
    total: int = 0

    def add(self, item: Item) -> Iterator[Piece]:
        """Take a document in; yields the pieces of the sequences that are thereby complete."""
        lim = self.limits
        while item.tokens >= lim.tokens and item.loss(lim.tokens) <= lim.loss:
            yield item, item.start, lim.tokens, self.sequence, 0
            self.sequence += 1
            item.start += lim.tokens
        if item.tokens:
            self.items.append(item)
            self.total += item.tokens
            if len(self.items) >= self.pool_size:
                yield from self.fill_while(self.pool_size // 2)

    def fill_while(self, keep: int) -> Iterator[Piece]:
        lim = self.limits
        # Columns: tokens, loss. Rows follow self.items; a spent row has no tokens.
        need = np.array([[i.tokens, i.loss(i.tokens)] for i in self.items], dtype=np.int64).reshape(-1, 2)
        left_items = len(self.items)
        while left_items > keep:
            # What the largest items can fill within the segments: a smaller power of two if they are short.
            most = need[:, 0] if left_items <= lim.segments else np.partition(need[:, 0], len(need) - lim.segments)[-lim.segments :]
            total = min(self.total, int(most.sum()))
            room = lim.tokens if total >= lim.tokens else 1 << (total.bit_length() - 1)
            segments, loss, offset = lim.segments, lim.loss, 0
            size = room
            while offset < size and segments and left_items:
                i = self._choose(need, size - offset, segments, loss, size)
                item = self.items[i]
                n = item.most(size - offset, loss)
                if n == 0:
                    break  # no loss-bearing token fits and every item begins with one
                yield item, item.start, n, self.sequence, offset
                loss -= item.loss(n)
                item.start += n
                offset += n
                segments -= 1
                self.total -= n
                need[i] = item.tokens, item.loss(item.tokens)
                left_items -= item.tokens == 0
            self.sequence += 1
        self.items = [i for i in self.items if i.tokens]

    def _choose(self, need: np.ndarray, tokens: int, segments: int, loss: int, size: int) -> int:
        lim = self.limits
        t, lo = need[:, 0], need[:, 1]
        fits = (t > 0) & (t <= tokens) & (lo <= loss)
        if segments > 1 and fits.any():
            dot = t * (tokens / lim.tokens**2) + lo * (loss / lim.loss**2) + segments / lim.segments**2
            return int(np.where(fits, dot, -1.0).argmax())
        # The item of which most fits, whole or cut.
        part = np.minimum(np.minimum(t, tokens), (t - lo) + loss)
        return int(part.argmax())


def pack_texts(
    docs: DataFrame,
    limits: Limits = Limits(),
    end_id: int = 1,
    path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss (and ids).

    ``prompt_col`` (an integer column) says how many leading tokens of a document bear no loss; null
    is 0. ``sequence_id`` is unique over the table; its upper bits are the partition.
    """
    path = path or default_path("byte_bpe_50k.json")
    src = docs.select(id_col, text_col, *([prompt_col] if prompt_col else []))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss", *(["ids"] if with_ids else [])]
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = byte_tokenizer(path), Packer(limits)
        first = TaskContext.get().partitionId() << 36
        id_type = None

        def rows(pieces: list[Piece]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in names]
            for item, start, n, sequence, offset in pieces:
                ids = item.ids[4 * start : 4 * (start + n)]
                loss = max(0, start + n - max(start, item.loss_from))
                values = [item.doc, start, n, zlib.crc32(ids), item.total, first + sequence, offset, loss]
                if with_ids:
                    values.append(np.frombuffer(ids, "<u4").astype("int64"))
                for c, v in zip(cols, values):
                    c.append(v)
            kinds = [id_type, *[pa.int64()] * 7, *([pa.list_(pa.int64())] if with_ids else [])]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for batch in batches:
            id_type = batch.schema[0].type
            ids = batch.column(0).to_pylist()
            prompts = batch.column(2).to_pylist() if prompt_col else None
            for at, texts in slices(batch.column(1)):
                out: list[Piece] = []
                for k, encoded in enumerate(tokenizer.encode(texts), at):
                    whole = encoded + end
                    item = Item(ids[k], whole, 0, len(whole) // 4, (prompts[k] or 0) if prompts else 0)
                    out += packer.add(item)
                    if len(out) >= 20_000:
                        yield rows(out)
                        out = []
                if out:
                    yield rows(out)
        tokenizer.forget()
        if id_type is not None and packer.items:
            yield rows(list(packer.fill_while(0)))

    kind = src.schema[0].dataType.simpleString()
    tail = ", ids array<bigint>" if with_ids else ""
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, n_loss bigint{tail}"
    return src.mapInArrow(run, schema)
