"""BPE encoding and decoding by a traversal of the trie of distinct words.

Texts are cut at ASCII white space; each distinct piece is encoded once per task. The pre-tokens of
the new pieces form a trie, visited depth first (sorted words, one stack). Every node carries the
last token of the encoding of its prefix and where that token begins, so a shared prefix is encoded
once, and a node needs only the tokens that end at it: the one that stays beside the last token of
the prefix before it is the next one. A word's encoding is read back along the last tokens.

Texts: null counts as empty (no ids, empty decoding). Very long texts are handled as one row; what
is held besides is the batch and a bounded memo of pieces. Rows are independent: repeated rows give
repeated results, an empty table an empty one, and other columns do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from tidemark.llm.vocab import WordVocab, default_path, word_vocab

#: Distinct pieces that a task remembers before it starts a new memo, keeping the old one until the next.
MEMO = 400_000


class TrieEncoder:
    """Ids (little-endian unsigned 32 bits) and decoded text of pieces and texts."""

    def __init__(self, vocab: WordVocab, memo: int = MEMO):
        self.vocab, self.limit = vocab, memo
        self.as_bytes = {t: i.to_bytes(4, "little") for t, i in vocab.ids.items()}
        self.tokens: dict[str, list[str]] = {}
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, str] = {}
        self.older: tuple[dict[bytes, bytes], dict[bytes, str]] = {}, {}

    def encode_words(self, words: set[str]) -> dict[str, list[str]]:
        """Tokens of each word (byte symbols), by one depth-first walk over their trie."""
        vocab, suffix, out = self.vocab, self.vocab.suffix, {}
        solid, reach, memo, stays = vocab.solid, vocab.reach, vocab.pair_memo, vocab.stays
        path = ""  # the prefix whose nodes are on the stack
        last: list[str] = [""]  # last[i]: last token of the encoding of path[:i]
        for word in sorted(words):
            size = len(word)
            shared, most = 0, min(size - 1, len(path))
            if word[:most] == path[:most]:
                shared = most
            else:
                while path[shared] == word[shared]:
                    shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, size + 1):
                tail = suffix if end == size else ""
                # The one token that ends here and stays beside what is encoded before it.
                far = reach.get(word[max(0, end - 2) : end] + tail, 1)
                for start in range(end - far if end > far else 0, end):
                    token = word[start:end] + tail
                    if token in solid:
                        ok = memo.get((last[start], token))
                        if stays(last[start], token) if ok is None else ok:
                            break
                else:
                    raise ValueError(f"no token ends at {end} of {word!r}")
                last.append(token)
            path = word[:-1]
            token = last.pop()
            tokens, at = [token], size + len(suffix) - len(token)
            while at:
                token = last[at]
                tokens.append(token)
                at -= len(token)
            tokens.reverse()
            out[word] = tokens
        return out

    def learn(self, pieces: set[bytes]) -> None:
        """Add the pieces' ids and decoded texts to the memo, taking over what an older memo has."""
        old_ids, old_decoded = self.older
        cut = {}
        for p in pieces:
            if p in old_ids:
                self.ids[p], self.decoded[p] = old_ids[p], old_decoded[p]
            else:
                cut[p] = self.vocab.words(p)
        if len(self.tokens) > self.limit:
            self.tokens = {}
        tokens, as_bytes = self.tokens, self.as_bytes
        tokens |= self.encode_words({w for words in cut.values() for w in words} - tokens.keys())
        for piece, words in cut.items():
            flat = tokens[words[0]] if len(words) == 1 else [t for w in words for t in tokens[w]]
            self.ids[piece] = b"".join([as_bytes[t] for t in flat])
            self.decoded[piece] = " ".join(flat)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids and decoding (tokens joined by one space) of each text."""
        if len(self.ids) > self.limit:
            self.older, self.ids, self.decoded = (self.ids, self.decoded), {}, {}
        parts = [[s if isinstance(s, int) else s.encode("utf-8", "surrogatepass").split() for s in self.vocab.segments(t or "")] for t in texts]
        new: set[bytes] = set()
        for text in parts:
            for s in text:
                if not isinstance(s, int):
                    new.update(s)
        new -= self.ids.keys()
        if new:
            self.learn(new)
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        names, out = {i: s for s, i in self.vocab.specials.items()}, []
        for text in parts:
            out.append((
                b"".join([s.to_bytes(4, "little") if isinstance(s, int) else b"".join(map(ids, s)) for s in text]),
                " ".join(filter(None, [names[s] if isinstance(s, int) else " ".join(filter(None, map(decoded, s))) for s in text])),
            ))
        return out


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder per Python worker and vocabulary; its memo lasts from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(word_vocab(path))
    return _ENCODERS[path]


def slices(texts: pa.Array, chars: int = 6_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows of about ``chars`` characters, so that Python strings of a batch stay few."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= chars:
            yield start, texts.slice(start, i + 1 - start).to_pylist()
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, texts.slice(start).to_pylist()
    # Workers live on through later stages; what the batch took goes back.
    pa.default_memory_pool().release_unused()


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` (array of long) and ``decoded`` of every text, all as the library gives them."""
    path = path or default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(path)
        for batch in batches:
            for start, texts in slices(batch.column(1)):
                got = enc.encode(texts)
                ids = pa.array([np.frombuffer(g[0], "<u4").astype("int64") for g in got], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), ids, pa.array([g[1] for g in got], pa.string())], names=[id_col, "ids", "decoded"]
                )

    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<bigint>, decoded string")


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text."""
    path = path or default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            counts: list[int] = []
            ids_sha: list[str] = []
            text_sha: list[str] = []
            for _, texts in slices(batch.column(1)):
                for ids, decoded in enc.encode(texts):
                    counts.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    src = docs.select(id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
