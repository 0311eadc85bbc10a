"""BPE encoding, token counts and packing against the tokenizers library and exact round trips."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.data import documents, empty, texts
from tidemark.llm.bpe_trie import TrieEncoder, encode_digests, encode_texts
from tidemark.llm.byte_ids import ByteTokenizer
from tidemark.llm.packing import Item, Limits, Packer, pack_texts
from tidemark.llm.token_fst import TokenCounter, token_counts
from tidemark.llm.vocab import default_path, word_vocab

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def test_trie_encoding_equals_the_library(library):
    enc = TrieEncoder(word_vocab(WORD), memo=50)  # a small memo is renewed between the two calls
    for _ in range(2):
        for text, (ids, decoded) in zip(texts(), enc.encode(texts())):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert decoded == library.decode(want, skip_special_tokens=False)


def test_transducer_counts_at_any_chunk_size(library):
    counts = TokenCounter(word_vocab(WORD))
    for text in texts():
        want = len(library.encode(text or "", add_special_tokens=False).ids)
        for size in (1, 7, 1 << 16) if len(text or "") < 3000 else (501, 1 << 16):
            assert counts.count(text or "", size) == want, (text, size)


def test_chunk_maps_compose_associatively():
    c = TokenCounter(word_vocab(WORD))
    maps = [c.chunk(x) for x in (b"the", b"", b"re is", b" ", b"a wo", b"rd", b"\n\n", b"end")]
    for i in range(len(maps) - 2):
        a, b, d = maps[i : i + 3]
        assert c.compose(c.compose(a, b), d) == c.compose(a, c.compose(b, d))


def test_digests_and_counts_of_a_table(spark, library):
    docs = documents(spark)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_digests(docs).collect()}
    want = set()
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want
    lengths = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, 2048).collect()}
    sizes = {(r.doc_id, len((r.text or "").encode())) for r in docs.collect()}
    assert {x[:2] for x in lengths} == sizes
    assert {(x[0], x[2]) for x in lengths} == {x[:2] for x in want}
    assert all(x[3] == (x[2] > 2048) for x in lengths) and any(x[3] for x in lengths)
    assert encode_texts(docs.filter("doc_id = 21")).first().decoded == "word</w>"
    for q in (encode_digests(empty(spark)), token_counts(empty(spark), 5), pack_texts(empty(spark))):
        assert q.count() == 0


def test_byte_ids_equal_the_library():
    tok = ByteTokenizer(BYTE)
    odd = ["a  b   c", "a \n b", "\n\n  x", "<|endoftext|>a  <|endoftext|> b", "a <|endoftext|>  ", "tab\t x\t\ty", "\x00 a", " \x1c b", "x \x85 y", " lead", "end "]
    for text, ids in zip([*texts(), *odd], tok.encode([*texts(), *odd])):
        assert np.frombuffer(ids, "<u4").tolist() == tok.library.encode(text or "", add_special_tokens=False).ids, text


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 64), Limits(100, 8, 40)])
def test_packing_is_a_partition_of_all_ids_within_limits(spark, limits):
    docs = documents(spark)
    lib = Tokenizer.from_file(BYTE)
    pieces = pack_texts(docs, limits, with_ids=True).collect()
    # A row stored twice is packed twice, so rows are compared as lists of their pieces' ids.
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*lib.encode(r.text or "", add_special_tokens=False).ids, 1])
    got = defaultdict(lambda: defaultdict(int))
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        assert p.ids == want[p.doc_id][0][p.start : p.start + p.length] and p.doc_tokens == len(want[p.doc_id][0])
        for k in range(p.start, p.start + p.length):
            got[p.doc_id][k] += 1
        sequences[p.sequence_id].append(p)
    for doc, rows in want.items():
        assert dict(got[doc]) == {k: len(rows) for k in range(len(rows[0]))}
    padding = 0
    for rows in sequences.values():
        rows.sort(key=lambda p: p.offset)
        assert [p.offset for p in rows] == np.cumsum([0, *[p.length for p in rows]])[:-1].tolist()
        size = sum(p.length for p in rows)
        assert size <= limits.tokens and len(rows) <= limits.segments and sum(p.n_loss for p in rows) <= limits.loss
        padding += 0 if size & (size - 1) == 0 else limits.tokens - size
    if limits.loss == limits.tokens:
        assert padding <= 0.02 * sum(p.length for p in pieces)


def test_packing_counts_prompt_tokens_as_bearing_no_loss():
    packer = Packer(Limits(10, 4, 4), pool_size=4)
    items = [Item(k, b"\0\0\0\0" * n, 0, n, prompt) for k, (n, prompt) in enumerate([(10, 8), (7, 0), (10, 0), (3, 3), (1, 0), (5, 2)])]
    total = sum(i.total for i in items)
    pieces = [(i, s, n, q) for item in items for i, s, n, q, _ in packer.add(item)] + [(i, s, n, q) for i, s, n, q, _ in packer.fill_while(0)]
    assert sum(n for _, _, n, _ in pieces) == total
    loss = defaultdict(int)
    for i, s, n, q in pieces:
        loss[q] += max(0, s + n - max(s, i.loss_from))
    assert max(loss.values()) <= 4


@pytest.mark.parametrize("size", [1, 2, 5, 20, 24, 30, 33, 63, 100])
def test_padding_is_little_for_documents_of_any_length(size):
    packer = Packer(Limits(2048, 64, 2048))
    pieces = [p for k in range(6000) for p in packer.add(Item(k, b"", 0, size))] + list(packer.fill_while(0))
    fill, segments = defaultdict(int), defaultdict(int)
    for _, _, n, sequence, offset in pieces:
        assert offset == fill[sequence]
        fill[sequence] += n
        segments[sequence] += 1
    assert sum(fill.values()) == 6000 * size and max(segments.values()) <= 64
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in fill.values())
    assert padding <= 0.02 * 6000 * size
