"""SentencePiece agenda, ranked search and hard negatives against the library and brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import documents, empty, texts
from tidemark.llm import block_max
from tidemark.llm.block_max import Postings, Scorer, ShardSearch, ShardWriter, build_index, pack_numbers, search, unpack_numbers
from tidemark.llm.four_russians import bit_planes, fitting, mine, scores, subset_tables
from tidemark.llm.piece_agenda import PieceEncoder, Pieces, decode_ids, differences, encode_texts, piece_digests
from tidemark.llm.vocab import default_path

MODEL = default_path("piece_bpe_32k.model")
ODD = [" ", "  ", "\n\n a", " \n", "a \n b", "▁", "▁a", "a▁ b", " " * 100, "x" + " " * 57 + "y", "\t\ta", "�", "<s></s><unk><0x41>", "👍🏽" * 30, "$,\"²."]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(MODEL)


def test_agenda_equals_the_library(pieces):
    r = random.Random(3)
    drawn = ["".join(r.choice(" \n\tab▁éx日<>👍\x00.,\"' the") for _ in range(r.randint(1, 40))) for _ in range(800)]
    enc, lib = PieceEncoder(pieces, memo=60), pieces.library
    for text in [*texts(), *ODD, *drawn]:
        ids, decoded = enc.encode([text])[0]
        want = lib.encode(text or "", add_eos=True)
        assert list(map(int, ids.split())) == want, text
        assert decoded == lib.decode(want) == pieces.decode(want), text


def test_decoding_of_any_ids_equals_the_library(pieces):
    r = random.Random(4)
    for _ in range(2000):
        ids = [r.choice([r.randrange(260), r.randrange(3, 32000), 28705, 259]) for _ in range(r.randint(0, 8))]
        assert pieces.decode(ids) == pieces.library.decode(ids), ids


def test_list_and_heap_agendas_agree(pieces):
    for t in texts():
        for part in pieces.parts((t or "")[:3000]):
            part = part.replace(" ", "▁")
            assert pieces._by_heap(part) == pieces._by_list(part)


def test_a_long_unbroken_part(pieces):
    text = "ab" * 50_000
    assert pieces.merge(" " + text) == pieces.library.encode(text)


def test_piece_tables(spark, pieces):
    docs = documents(spark)
    lib = pieces.library
    want = set()
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert {tuple(r) for r in piece_digests(docs).collect()} == want
    assert differences(docs).count() == 0
    encoded = encode_texts(docs)
    back = {(r.doc_id, r.text) for r in decode_ids(encoded).collect()}
    assert back == {(r.doc_id, r.decoded) for r in encoded.collect()}
    for q in (piece_digests(empty(spark)), encode_texts(empty(spark)), differences(empty(spark))):
        assert q.count() == 0


def test_numbers_of_seven_bits():
    x = np.array([0, 1, 127, 128, 16383, 16384, 10**9, 2**40, 5])
    assert unpack_numbers(pack_numbers(x)[0].tobytes()).tolist() == x.tolist()
    assert len(unpack_numbers(b"")) == 0 and len(pack_numbers(np.zeros(0, int))[0]) == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))


def _ranked(docs, items, k):
    """Each item's best k as (item, rank, doc, score), from every document's score."""
    rows = [(i, c, sum(c.values())) for i, c in ((i, _terms(t)) for i, t in docs) if c]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        asked = _terms(text)
        found = []
        for i, c, size in rows:
            m = 25 + (75 * size * n) // total
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank + 1, i, -s) for rank, (s, _, i) in enumerate(found[:k])]
    return out


@pytest.mark.parametrize("shard,pack,k", [(200, 300, 3), (20_000, 4_000_000, 10)])
def test_search_equals_brute_force_over_shards_and_packs(spark, shard, pack, k):
    r = random.Random(5)
    pool = [f"w{int(r.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(pool, k=r.randint(1, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(150)]  # copies: ties by id
    docs += [(7, docs[7][1]), (None, "w1 rare"), (5001, None), (5002, ""), (5003, " .,"), (5004, "Ärger ärger W1 w1")]
    docs.append((5005, "w1 w2 " * 30_000))
    items = [(i, " ".join(r.choices(pool, k=r.randint(1, 30)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, docs[7][1]), (103, "rare rare w1"), (104, "Ärger")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("term", F.lit("x")).repartition(3)
    q = spark.createDataFrame(items, "item_id int, text string").withColumn("rank", F.lit(1))
    index = build_index(d, shard_bytes=shard)
    got = Counter(tuple(x) for x in search(index, q, k, pack_bytes=pack).collect())
    assert got == Counter(_ranked(docs, items, k))
    index.drop()


def test_search_of_empty_tables(spark):
    q = spark.createDataFrame([(1, "word")], "item_id int, text string")
    index = build_index(empty(spark))
    found = search(index, q)
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]
    index = build_index(documents(spark))
    assert search(index, q.limit(0)).count() == 0
    assert search(index, q).count() == 1


def _shard(docs):
    writer = ShardWriter()
    for i, t in docs:
        writer.add(i, t.encode())
    lists, lengths = {}, None
    for batch in writer.rows("s"):
        for r in batch.to_pylist():
            if r["term"] == "":
                ids, lengths = np.array(r["ids"]), unpack_numbers(r["postings"])
            else:
                lists.setdefault(r["term"], []).append((r["first"], r["last"], r["peaks"], r["postings"]))
    scorer = Scorer(len(ids), int(lengths.sum()))
    return ShardSearch(ids, {t: Postings(rows, lengths, scorer) for t, rows in lists.items()}), scorer, lengths


def test_block_maxima_are_exact_and_spare_blocks():
    r = random.Random(6)
    docs = [(i, " ".join(["common"] * r.randint(1, 3) + ["filler"] * r.randint(0, 30) + (["rare"] * 5 if i % 997 == 5 else []))) for i in range(20_000)]
    shard, scorer, lengths = _shard(docs)
    for p in shard.lists.values():
        for b, most in enumerate(p.most):
            assert p.block(b)[1].max() == most
        p._open.clear()
    query = [("rare", scorer.weight(21)), ("common", 1), ("filler", 1)]
    places, found = shard.best(query, 10, 0)
    assert len(places) >= 10
    blocks = sum(len(p.first) for p in shard.lists.values())
    assert shard.opened < blocks / 4, (shard.opened, blocks)


@pytest.mark.parametrize("low,high,dims", [(-256, 256, 64), (0, 5, 3), (0, 1, 8), (-1, 1, 8), (-70_000, 70_000, 17), (-128, -100, 9), (-5, 6, 0)])
def test_lookups_give_the_inner_product(low, high, dims):
    r = np.random.default_rng(2)
    a, c = r.integers(low, high, (7, dims)), r.integers(low, high, (11, dims))
    planes = bit_planes(c)
    assert (scores(subset_tables(a).astype(fitting(a, len(planes))), planes) == c @ a.T).all()


def _mined(rows, positives, negatives):
    usable = [(i, np.floor(256 * np.array(e, float)), l) for i, e, l in rows if l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, (ai, av, al) in enumerate(usable):
        if ai is None or ai % 10:
            continue
        scored = sorted(((-int(v @ av), math.inf if i is None else i, l, k) for k, (i, v, l) in enumerate(usable) if len(v) == len(av)), key=lambda x: x[:2])
        for ps, pi, _, _ in [s for s in scored if s[2] == al and s[3] != a][:positives]:
            far = [s for s in scored if s[2] != al and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:negatives]
            out += [(ai, None if pi == math.inf else pi, k + 1, None if n == math.inf else n, -ps, -s) for k, (s, n, _, _) in enumerate(far)]
    return Counter(out)


@pytest.mark.parametrize("pack,block", [(2000, 16), (4_000_000, 2048)])
def test_hard_negatives_equal_brute_force(spark, pack, block):
    r = np.random.default_rng(7)
    base = r.normal(size=(4, 12))
    rows = [(i, (base[i % 4] + 0.4 * r.normal(size=12)).tolist(), int(r.integers(0, 3))) for i in range(200)]
    rows += [(300 + i, rows[20][1], 1) for i in range(60)]  # copies: ties by id
    rows += [(20, rows[20][1], rows[20][2]), (None, rows[30][1], 1), (400, None, 1), (410, rows[1][1], None), (420, [None] * 12, 2), (430, [math.nan] * 12, 2)]
    rows += [(440, [math.inf] + [0.0] * 11, 2), (450, [0.0] * 12, 0), (460, [1.0, 2.0], 0), (470, [1.0, 2.0], 0), (471, [1.0, 1.9], 1), (480, [], 0), (481, [], 1), (482, [], 0)]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint").withColumn("row", F.lit(1)).withColumn("key", F.lit(2)).repartition(3)
    got = mine(d, F.col("vec_id") % 10 == 0, 5, 5, pack_bytes=pack, block=block)
    assert Counter(tuple(x) for x in got.collect()) == _mined(rows, 5, 5)
    assert mine(d.limit(0), F.lit(True)).count() == 0
    assert mine(d.filter("vec_id = 3"), F.lit(True)).count() == 0


def test_search_and_mining_queries_read_only_what_they_need(spark):
    q = spark.createDataFrame([(1, "word")], "item_id int, text string")
    assert block_max.ranked(documents(spark), q).count() == 1
