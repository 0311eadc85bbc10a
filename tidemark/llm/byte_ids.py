"""Ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

Texts are cut before each space and each distinct cut is encoded once. A space that follows white
space and stands before white space (or ends the text) can share a token with its neighbours, and
special strings are found in the whole text first; texts with either go to the library whole. The
cuts, one word each, are encoded by ``tiktoken`` from the same file's vocabulary, which costs a tenth
of the library's overhead for a call. That needs merges in the order of their ids and the usual
pattern, both checked when the file is read; where they fail, the library encodes the cuts too.
"""

from __future__ import annotations

import json
import os
import re

from tidemark.llm.vocab import byte_symbols

#: Distinct cuts that a task remembers before it starts a new memo, keeping the old one until the next.
#: Both are dropped when the task ends, so that a worker does not carry them through later stages.
MEMO = 150_000

#: Fixed value: the pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SHARED = re.compile(r"\s (?:\s|\Z)")


class ByteTokenizer:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.limit = memo
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.plain = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.words = self._by_rank(path)

    def _by_rank(self, path: str):
        """An encoder of single words by ranks, or None if the file's merges do not follow its ids."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, rules = spec["model"]["vocab"], spec["pre_tokenizer"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        if rules.get("type") != "ByteLevel" or not rules.get("use_regex") or rules.get("add_prefix_space") or spec["normalizer"]:
            return None
        if [vocab[t] for t in made] != list(range(256, 256 + len(made))):
            return None
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.specials}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def cut_ids(self, cuts: list[str]) -> list[bytes]:
        if self.words is None:
            return self.whole(cuts)
        words, plain = self.words, self.plain
        return [b"".join([plain[i] for i in words(c)]) for c in cuts]

    def forget(self) -> None:
        self.ids, self.older = {}, {}

    def whole(self, texts: list[str]) -> list[bytes]:
        plain = self.plain
        return [b"".join([plain[i] for i in e.ids]) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null counts as empty."""
        if len(self.ids) > self.limit:
            self.older, self.ids = self.ids, {}
        ids, older = self.ids, self.older
        cuts: list[list[str] | None] = []
        new: set[str] = set()
        for t in texts:
            t = t or ""
            if _SHARED.search(t) or any(s in t for s in self.specials):
                cuts.append(None)
                continue
            # The first cut has no space before it; no other cut holds a space, so the mark is its own.
            parts = t.split(" ")
            parts[0] = "\x00 " + parts[0]
            cuts.append(parts)
            new.update(parts)
        new -= ids.keys()
        for p in new & older.keys():
            ids[p] = older[p]
        todo = [p for p in new if p not in ids]
        for i in range(0, len(todo), 20_000):
            some = todo[i : i + 20_000]
            ids.update(zip(some, self.cut_ids([p[2:] if p.startswith("\x00 ") else " " + p for p in some])))
        get = ids.__getitem__
        return [self.whole([t or ""])[0] if parts is None else b"".join(map(get, parts)) for t, parts in zip(texts, cuts)]


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def byte_tokenizer(path: str) -> ByteTokenizer:
    """One per Python worker and file; a task calls ``forget`` at its end."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]
