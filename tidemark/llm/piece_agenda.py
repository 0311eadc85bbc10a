"""SentencePiece encoding and decoding for merge-type vocabularies by an agenda of adjacent pairs.

A text is normalised as the model asks (a space in front, spaces as U+2581) and cut where no piece can
reach across: before spaces that follow a letter, around white space that is part of no piece, and
before marks that no piece holds behind a letter. A distinct part is encoded once per worker: its characters are symbols in a linked list, and every
adjacent pair that forms a piece waits on an agenda ordered by the piece's score, then by place. The
best pair is merged, pairs with its new neighbours join the agenda, and entries whose symbols have
changed meanwhile are passed over. Symbols that are no piece become byte tokens, else the unknown id.
Decoding turns ids back into pieces, joins byte tokens to characters (U+FFFD for bytes that form none)
and takes the space in front away.

Each batch of new parts is checked against the ``sentencepiece`` library, which raises if one differs;
``differences`` compares whole texts.

Texts: null counts as empty (only the end id, empty decoding). A very long text is one row's work; a
long unbroken part costs n log n. Memory holds one slice of a batch and a bounded memo. Rows are
independent: repeated rows give repeated results, an empty table an empty one, and other columns are
not read, whatever their names. Equal scores are merged from the left.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.bpe_trie import slices
from tidemark.llm.vocab import default_path

#: Distinct parts that a worker remembers; a full memo is kept beside a new one until that is full too.
MEMO = 300_000
SPACE = "▁"
#: Parts of up to so many characters keep their agenda as a list by place, longer ones as a heap.
SHORT = 40
_LEFT, _SIZE = 32, 16  # bits of a heap entry below the score's rank
_NONE = 1 << 40
_LETTER = "[A-Za-z\u00C0-\u024F]"


class Pieces:
    """Pieces of one model file: ids, score ranks and the characters at which texts can be cut."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.get_piece_size()
        self.names = [lib.id_to_piece(i) for i in range(size)]
        fixed = {i for i in range(size) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        scores = {i: lib.get_score(i) for i in range(size) if i not in fixed}
        place = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ids = {self.names[i]: i for i in scores}
        self.rank = {self.names[i]: place[s] for i, s in scores.items() if len(self.names[i]) > 1}
        self.bytes = {int(self.names[i][3:5], 16): i for i in fixed if lib.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in fixed if lib.is_control(i)}
        self.plain = {i: n.replace(SPACE, " ") for n, i in self.ids.items()}
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        probe = "  Ab\té é ﬁ ½  z "
        if lib.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{path}: normalises more than spaces")
        if any(lib.is_unused(i) for i in range(size)) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError(f"{path}: pieces that are unused or cross from a word to the next are not supported")
        apart = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        self.apart = apart[:1]
        before: dict[str, str] = {}
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                before[y] = before.get(y, "") + x
        # Marks that no piece holds behind a Latin letter; texts are cut there too.
        mark = "".join(re.escape(y) for y in string.punctuation if not re.search(_LETTER, before.get(y, "")))
        rest = f"[^ {SPACE}{apart}{mark}]*"
        run = f"[ {SPACE}]*[^ {SPACE}{apart}]{rest}" + (f"(?:(?<!{_LETTER})[{mark}]{rest})*" if mark else "")
        self._cut = re.compile(f"{run}|[ {SPACE}]+" + (f"|[{apart}]" if apart else ""))

    def parts(self, text: str | None) -> list[str]:
        """Pieces of text that can be encoded apart, with spaces as they are and the one in front added."""
        return self._cut.findall(" " + text) if text else []

    def merge(self, part: str) -> list[int]:
        """Ids of one part by the agenda."""
        text = part.replace(" ", SPACE)
        symbols = self._by_list(text) if len(text) <= SHORT else self._by_heap(text)
        try:
            return [self.ids[s] for s in symbols]
        except KeyError:
            out: list[int] = []
            for s in symbols:
                i = self.ids.get(s)
                if i is not None:
                    out.append(i)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
            return out

    def _by_list(self, text: str) -> list[str]:
        """Symbols after all merges; the agenda holds the score rank of each place's pair."""
        rank = self.rank.get
        symbols = list(text)
        agenda = [rank(a + b, _NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != _NONE:
            at = agenda.index(best)
            symbols[at] = own = symbols[at] + symbols[at + 1]
            del symbols[at + 1], agenda[at]
            if at < len(agenda):
                agenda[at] = rank(own + symbols[at + 1], _NONE)
            if at:
                agenda[at - 1] = rank(symbols[at - 1] + own, _NONE)
        return symbols

    def _by_heap(self, text: str) -> list[str]:
        """The same with a linked list of symbols and a heap of entries (rank, place, size), stale ones passed over."""
        rank, n = self.rank, len(text)
        symbols = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            r = rank.get(text[i : i + 2])
            if r is not None:
                agenda.append(((r << _LEFT | i) << _SIZE) | 2)
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            top = pop(agenda)
            left, size = (top >> _SIZE) & 0xFFFFFFFF, top & 0xFFFF
            right = after[left]
            own = symbols[left]
            if not own or right >= n or len(own) + len(symbols[right]) != size:
                continue
            symbols[left] = own = own + symbols[right]
            symbols[right] = ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                r = rank.get(own + symbols[right])
                if r is not None:
                    push(agenda, ((r << _LEFT | left) << _SIZE) | (size + len(symbols[right])))
            if (prev := before[left]) >= 0:
                r = rank.get(symbols[prev] + own)
                if r is not None:
                    push(agenda, ((r << _LEFT | prev) << _SIZE) | (size + len(symbols[prev])))
        return [s for s in symbols if s]

    def surface(self, ids: list[int]) -> str:
        """Text of ids in the midst of a text, the space in front included."""
        try:
            return "".join([self.plain[i] for i in ids])
        except KeyError:
            return self._surface(ids)

    def _surface(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_characters(bytes(run)))
                run.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i >= 0 and i not in self.silent:
                out.append(self.plain[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a whole list of ids: the space in front of the first token with text goes."""
        text = self.surface(ids)
        spoken = next((i for i in ids if i not in self.silent), self.unknown)
        return text[1:] if self.names[spoken].startswith(SPACE) else text

    def by_library(self, parts: list[str]) -> list[list[int]]:
        """The library's ids of each part; parts without a space in front are read behind a character that stays apart."""
        ahead = len(self.library.encode(self.apart)) if self.apart else 0
        got = self.library.encode([p[1:] if p[0] == " " and len(p) > 1 else self.apart + p for p in parts], num_threads=1)
        return [ids if p[0] == " " and len(p) > 1 else ids[ahead:] for p, ids in zip(parts, got)]


def _characters(data: bytes) -> str:
    """UTF-8 text of ``data``; every byte that starts no character becomes U+FFFD."""
    out: list[str] = []
    while data:
        try:
            return "".join([*out, data.decode()])
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), "�"]
            data = data[e.start + 1 :]
    return "".join(out)


class PieceEncoder:
    """Ids and decoded texts, with a bounded memo of parts (decimal ids joined by spaces, decoded text)."""

    def __init__(self, pieces: Pieces, memo: int = MEMO):
        self.pieces, self.limit = pieces, memo
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        self.older: tuple[dict[str, bytes], dict[str, str]] = {}, {}

    def learn(self, parts: set[str]) -> None:
        old_ids, old_decoded = self.older
        fresh = []
        for p in parts:
            if p in old_ids:
                self.ids[p], self.decoded[p] = old_ids[p], old_decoded[p]
            else:
                fresh.append(p)
        found = list(map(self.pieces.merge, fresh))
        known = self.pieces.by_library([p for p in fresh if p != " "])
        for p, ids, want in zip([p for p in fresh if p != " "], [i for p, i in zip(fresh, found) if p != " "], known):
            if ids != want:
                raise ValueError(f"ids of {p!r} differ from the library's: {ids} and {want}")
        for p, ids in zip(fresh, found):
            self.ids[p] = b" ".join([b"%d" % i for i in ids])
            self.decoded[p] = self.pieces.surface(ids)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Decimal ids with the end id, and the decoding, of each text."""
        if len(self.ids) > self.limit:
            self.older, self.ids, self.decoded = (self.ids, self.decoded), {}, {}
        cut = list(map(self.pieces.parts, texts))
        new = set().union(*cut) - self.ids.keys()
        if new:
            self.learn(new)
        ids, decoded, end = self.ids.__getitem__, self.decoded.__getitem__, b"%d" % self.pieces.end
        return [(b" ".join([*map(ids, parts), end]), "".join(map(decoded, parts))[1:]) for parts in cut]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and model; its memo lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(Pieces(path))
    return _ENCODERS[path]


def _model(path: str | None) -> str:
    return path or default_path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` (array of long, end id last) and ``decoded`` of every text."""
    path = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                got = enc.encode(texts)
                ids = pa.array([list(map(int, g[0].split())) for g in got], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids, pa.array([g[1] for g in got], pa.string())], names=[id_col, "ids", "decoded"])

    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<bigint>, decoded string")


def decode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``id_col`` and ``text`` of every array of ids; null counts as empty, a null id as the unknown one."""
    path = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path).pieces
        for batch in batches:
            texts = [pieces.decode([pieces.unknown if i is None else i for i in ids or []]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    src = rows.select(id_col, ids_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, text string")


def piece_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256`` of every text."""
    path = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts: list[int] = []
            ids_sha: list[str] = []
            text_sha: list[str] = []
            for _, texts in slices(batch.column(1), 3_000_000):
                for ids, decoded in enc.encode(texts):
                    counts.append(ids.count(b" ") + 1)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.select(id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def differences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Rows whose ids or decoding are not what the library gives for the whole text: ``id_col``, both lists of ids."""
    path = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        lib = enc.pieces.library
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                found = enc.encode(texts)
                wanted = lib.encode([t or "" for t in texts], add_eos=True, num_threads=1)
                back = lib.decode(wanted)
                own = [list(map(int, ids.split())) for ids, _ in found]
                off = [k for k, w in enumerate(wanted) if own[k] != w or found[k][1] != back[k]]
                cols = [pa.array([x[k] for k in off], pa.list_(pa.int64())) for x in (own, wanted)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)).take(pa.array(off, pa.int64())), *cols], names=[id_col, "ids", "library_ids"])

    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<bigint>, library_ids array<bigint>")
