"""Word-level BPE vocabularies: reading the file, normalising, cutting texts into pre-tokens.

A vocabulary is a JSON file of the ``tokenizers`` library with a byte-level BPE model whose words
end in a suffix. Its path is a parameter; every task reads it once. Two encoders stand on it: the
trie traversal of ``bpe_trie`` and the transducer of ``token_fst``.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import regex


def default_path(name: str) -> str:
    """Where the installed public vocabularies keep ``name``; any other path may be given instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class WordVocab:
    """Symbols, merges and text rules of one word-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a BPE vocabulary with word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.ranks = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(regex.escape(s) for s in self.specials) or r"(?!)")
        rules = spec["pre_tokenizer"]["pretokenizers"]
        self._words = regex.compile(rules[0]["pattern"]["Regex"])
        self._byte = byte_symbols()
        #: Symbols of the longest token that ends with the given two (or the one it has).
        self.reach: dict[str, int] = {}
        for t in self.ids:
            n = len(t) - (len(self.suffix) if t.endswith(self.suffix) else 0)
            end = t[max(0, n - 2) :]
            self.reach[end] = max(n, self.reach.get(end, 1))

    def segments(self, text: str) -> list[str | int]:
        """``text`` cut at special strings; these come as their id, the rest as normalised text."""
        out: list[str | int] = []
        at = 0
        if any(s in text for s in self.specials):
            for m in self._special.finditer(text):
                out += [self.normal(text[at : m.start()]), self.specials[m[0]]]
                at = m.end()
        out.append(self.normal(text[at:]) if at else self.normal(text))
        return out

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, character by character (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()

    def words(self, piece: bytes) -> list[str]:
        """Pre-tokens of a normalised piece without ASCII white space, as byte symbols."""
        if piece.isalpha():
            return [piece.decode()]
        text = piece.decode("utf-8", "surrogatepass")
        found = self._words.findall(text)
        if text.isascii():
            plain = self._byte
            return ["".join([plain[ord(c)] for c in w]) if not w.isalnum() else w for w in found]
        return ["".join([self._byte[b] for b in w.encode("utf-8", "surrogatepass")]) for w in found]

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a symbol list: again and again join the pair of lowest rank, leftmost first."""
        out, ranks, none = list(symbols), self.ranks, len(self.ranks)
        while len(out) > 1:
            found = [ranks.get(pair, none) for pair in zip(out, out[1:])]
            rank = min(found)
            if rank == none:
                break
            at = found.index(rank)
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def symbols(self, token: str) -> list[str]:
        """The single symbols that ``token`` is made of."""
        if token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    @functools.cached_property
    def solid(self) -> set[str]:
        """Tokens that BPE gives for their own text; no encoding holds any other."""
        return {t for t in self.ids if self.merge(self.symbols(t)) == [t]}

    @functools.cached_property
    def pair_memo(self) -> dict[tuple[str, str], bool]:
        return {}

    def stays(self, left: str, right: str) -> bool:
        """Whether BPE of two solid tokens' joined symbols gives just these two (``left`` may be empty).

        Any sequence all of whose neighbours stay is the BPE encoding of its text, so an encoder can
        go from token to token and never look further back than one of them.
        """
        key = (left, right)
        known = self.pair_memo.get(key)
        if known is None:
            if len(self.pair_memo) > 2_000_000:
                self.pair_memo.clear()
            known = self.pair_memo[key] = not left or self.merge(self.symbols(left) + self.symbols(right)) == [left, right]
        return known


@functools.lru_cache(maxsize=4)
def word_vocab(path: str) -> WordVocab:
    return WordVocab(path)
