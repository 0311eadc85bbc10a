"""Token counts by a compiled finite-state tokenizer.

The vocabulary is compiled, as far as the texts need it, into a deterministic transducer over the
byte symbols of a word. A state holds what later symbols can depend on: the longest suffix read that
begins some token, the last token of the encoding before each of its positions, and how many tokens
lie between. Each transition carries the number of tokens that it adds to the encoding (it can be
negative where a longer token replaces shorter ones); the symbol that ends a word has transitions of
its own. The sum along a word is its token count, so no encoding is ever built.

Texts are cut into chunks anywhere. A chunk's state map says, for any unfinished piece that comes
in, how many tokens it emits and which unfinished piece it leaves: (head, count, tail), where the
head completes the piece that comes in. Maps compose associatively; a prefix scan by doubling gives
each chunk's map from the text's start, the last of which holds the count.

Null and empty texts have 0 bytes and 0 tokens. A special string inside a text is one token. Rows are
independent, so repeated rows, an empty table and other columns need no rule. A very long text costs
memory in proportion to it, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from tidemark.llm.bpe_trie import slices
from tidemark.llm.vocab import WordVocab, default_path, word_vocab

#: Characters of a chunk.
CHUNK = 1 << 16
#: Compiled states and counted pieces that a task keeps; beyond, it starts anew.
STATES, PIECES = 300_000, 600_000

#: (head, count, tail), or (whole, None, None) for a chunk without white space.
Map = tuple[bytes, int | None, bytes | None]


class State:
    """A state of the transducer with the transitions compiled so far."""

    __slots__ = ("suffix", "lasts", "counts", "to")

    def __init__(self, suffix: str, lasts: tuple[str, ...], counts: tuple[int, ...]):
        self.suffix, self.lasts, self.counts = suffix, lasts, counts
        self.to: dict[str, tuple[State, int]] = {}


class TokenCounter:
    def __init__(self, vocab: WordVocab):
        self.vocab = vocab
        self.begins = {""}
        for t in vocab.solid:
            body = t[: -len(vocab.suffix)] if t.endswith(vocab.suffix) else t
            self.begins.update(body[:i] for i in range(1, len(body)))
        self.known: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state("", ("",), (0,))

    def state(self, suffix: str, lasts: tuple[str, ...], counts: tuple[int, ...]) -> State:
        key = (suffix, lasts, counts)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(*key)
        return found

    def transition(self, at: State, symbol: str, ends: bool) -> tuple[State, int]:
        """Compile the transition for a symbol inside a word, or for the symbol that ends it."""
        text, tail = at.suffix + symbol, self.vocab.suffix if ends else ""
        solid, stays = self.vocab.solid, self.vocab.stays
        for i, last in enumerate(at.lasts):
            token = text[i:] + tail
            if token in solid and stays(last, token):
                break
        else:
            raise ValueError(f"no token ends with {symbol!r} after {at.suffix!r}")
        emitted = at.counts[i] + 1
        if ends:
            made = self.start, emitted
        else:
            k = next(k for k in range(len(text) + 1) if text[k:] in self.begins)
            made = self.state(text[k:], (*at.lasts[k:], token), (*(c - emitted for c in at.counts[k:]), 0)), emitted
        at.to[symbol + tail] = made
        return made

    def word(self, word: str) -> int:
        """Tokens of a pre-token given as byte symbols."""
        at, total = self.start, 0
        for symbol in word[:-1]:
            move = at.to.get(symbol) or self.transition(at, symbol, False)
            at = move[0]
            total += move[1]
        end = word[-1]
        return total + (at.to.get(end + self.vocab.suffix) or self.transition(at, end, True))[1]

    def piece(self, piece: bytes) -> int:
        """Tokens of a piece between white space."""
        n = self.known.get(piece)
        if n is None:
            n = self.known[piece] = sum(map(self.word, self.vocab.words(piece)))
        return n

    def chunk(self, text: bytes) -> Map:
        pieces = text.split()
        if not pieces or (len(pieces) == 1 and len(pieces[0]) == len(text)):
            return (b"", 0, b"") if text and not pieces else (text, None, None)
        head = b"" if text[:1].isspace() else pieces.pop(0)
        tail = b"" if text[-1:].isspace() else pieces.pop()
        known = self.known
        try:
            return head, sum(map(known.__getitem__, pieces)), tail
        except KeyError:
            return head, sum([known[p] if p in known else self.piece(p) for p in pieces]), tail

    def compose(self, a: Map, b: Map) -> Map:
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        joined = a[2] + b[0]
        return a[0], a[1] + (self.piece(joined) if joined else 0) + b[1], b[2]

    def scan(self, maps: list[Map]) -> list[Map]:
        """Inclusive prefix scan by doubling: each round composes maps twice as far apart."""
        step = 1
        while step < len(maps):
            maps = [m if i < step else self.compose(maps[i - step], m) for i, m in enumerate(maps)]
            step *= 2
        return maps

    def count(self, text: str, size: int = CHUNK) -> int:
        total = 0
        for part in self.vocab.segments(text):
            if isinstance(part, int):
                total += 1
                continue
            raw = [part] if len(part) <= size else [part[i : i + size] for i in range(0, len(part), size)]
            head, n, tail = self.scan([self.chunk(c.encode("utf-8", "surrogatepass")) for c in raw])[-1]
            total += (self.piece(head) if head else 0) + (n or 0) + (self.piece(tail) if tail else 0)
        if len(self.known) > PIECES:
            self.known = {}
        if len(self.states) > STATES:
            self.reset()
        return total


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One per Python worker and vocabulary; what it has compiled lasts from task to task."""
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(word_vocab(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every text."""
    path = path or default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            tokens = [counts.count(t or "") for _, texts in slices(batch.column(1)) for t in texts]
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    src = docs.select(id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
