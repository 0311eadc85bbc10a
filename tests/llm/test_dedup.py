"""Near-duplicate, substring and fingerprint operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tests.llm.data import documents, empty, texts, words
from tidemark.llm.bottom_k import containment, distinct_shingles, edited_digests, merged, resemblance, sketch
from tidemark.llm.components import components
from tidemark.llm.gray_simhash import fingerprint, gray_rank, links_in_groups, near_digests, near_groups
from tidemark.llm.relative_lz import digests, factors, remove_repeats
from tidemark.llm.rp_forest import near_vectors
from tidemark.llm.simhash_copies import band_places, bands_for, copy_groups, first_of_copies, shingles, short_links, spanning_links, wide_print
from pyspark.sql import functions as F


def roots(n, pairs):
    at = list(range(n))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (300, 300)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).df.collect()}
    want = roots(301, pairs)
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert components(df.filter("a < 0")).df.count() == 0


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_gray_order():
    for t in texts():
        assert fingerprint(t) == plain_fingerprint(t)
    codes = np.arange(256, dtype=np.uint64)
    codes ^= codes >> np.uint64(1)
    assert gray_rank(codes).tolist() == list(range(256))


def test_index_links_every_near_pair():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)) for _ in range(600)]
    prints = np.unique(np.concatenate([centres, centres[rng.integers(0, 30, 600)] ^ np.array(flips, np.uint64)]))
    group = (prints % np.uint64(3)).astype(np.int64)
    order = np.lexsort((gray_rank(prints), group))
    prints, group = prints[order], group[order]
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    near &= group[:, None] == group[None]
    want = roots(len(prints), [(a, b) for a, b in np.argwhere(near) if a < b])
    a, b = links_in_groups(prints[:, None], group)
    assert near[a, b].all() and len(a) < len(prints)
    assert roots(len(prints), list(zip(a.tolist(), b.tolist()))) == want


@pytest.mark.parametrize("limit", [32_768, 3])
def test_simhash_groups(spark, limit):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(len(rows), pairs)
    low = {k: min(rows[i][0] for i in range(len(rows)) if root[i] == k) for k in set(root)}
    got = Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in near_groups(docs, group_limit=limit).collect())
    assert got == Counter((d, p, low[k]) for (d, _), p, k in zip(rows, prints, root))
    assert near_digests(docs.filter("text IS NULL")).first().fingerprint == "0" * 16
    assert near_digests(empty(spark)).count() == 0


def test_one_copy_of_each_group_stays(spark):
    base = words(300, 5)
    rows = [(10, " ".join(base)), (11, " ".join(base)), (11, " ".join(base))]
    for k in range(8):  # about 0.93 alike to the base
        near = base[:]
        near[30 * k + 5] = f"new{k}"
        near[30 * k + 15] = f"other{k}"
        rows.append((20 + k, " ".join(near)))
    far = base[:]
    for k in range(0, 300, 8):
        far[k] = f"far{k}"
    rows += [(30, " ".join(far)), (31, None), (32, ""), (33, "one"), (34, "one"), (None, "one"), (35, "two words")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_row", F.lit("kept"))
    got = first_of_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [10, 30, 31, 33, 35]
    assert first_of_copies(empty(spark)).count() == 0


def plain_repeats(all_words, window):
    seen = Counter(tuple(w[i : i + window]) for w in all_words for i in range(len(w) - window + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append(gone)
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_substring_dedup_equals_comparing_all_windows(spark, window):
    docs = documents(spark)
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()]
    want = []
    for (d, w), gone in zip(rows, plain_repeats([w for _, w in rows], window)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in digests(docs, window=window).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)
    assert digests(empty(spark)).count() == 0


@pytest.mark.parametrize("window", [35, 12])
def test_factors_stand_at_their_places(spark, window):
    """Every factor's words are those at its reference, elsewhere; factors cover repeated words only, and long copies in few pieces."""
    rows = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in documents(spark).dropDuplicates(["doc_id"]).collect()}
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows.items()], "doc_id bigint, text string")
    got = factors(docs, window=window).collect()
    ids = list(rows)
    gone = dict(zip(ids, plain_repeats([rows[d] for d in ids], window)))
    for f in got:
        assert f.words >= window and (f.doc_id, f["first"]) != (f.ref_id, f.ref_first)
        assert rows[f.doc_id][f["first"] : f["first"] + f.words] == rows[f.ref_id][f.ref_first : f.ref_first + f.words]
        assert all(gone[f.doc_id][f["first"] : f["first"] + f.words])
    assert len({(f.doc_id, f["first"]) for f in got}) == len(got)
    copies = [f for f in got if {f.doc_id, f.ref_id} == {35, 42}]
    assert copies and max(f.words for f in copies) > 60
    assert factors(empty(spark)).count() == 0


def test_removed_text_keeps_the_columns(spark):
    docs = documents(spark).withColumn("_spans", F.lit(1))
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    before, after = ({(r.doc_id, r.text) for r in f.collect()} for f in (docs, out))
    assert all((d, t) in after for d, t in before if t is None or len(t.split()) < 35)


@pytest.mark.parametrize("block, leaf", [(4096, 128), (16, 8)])
def test_vector_links(spark, block, leaf):
    r = random.Random(4)
    unit = lambda: [r.gauss(0, 1) for _ in range(16)]
    rows = [(i, unit()) for i in range(300)]
    centre = unit()
    rows += [(1000 + i, [x + r.gauss(0, 0.08) for x in centre]) for i in range(90)]
    rows += [(2000 + i, [2.0 * x for x in centre]) for i in range(3)] + [(2000, [2.0 * x for x in centre])]
    bad = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] + [1.0] * 15), (3004, [float("inf")] + [1.0] * 15), (3005, []), (3006, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, "a") for x in rows + bad], "vec_id bigint, embedding array<double>, n string")
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    root = roots(len(rows), [(a, b) for a, b in np.argwhere(near) if a < b])
    low = {k: min(rows[i][0] for i in range(len(rows)) if root[i] == k) for k in set(root)}
    want = [(rows[i][0], int(near[i].sum()) - 1, low[root[i]]) for i in range(len(rows))]
    got = near_vectors(df, block=block, leaf=leaf).collect()
    assert Counter((g.vec_id, g.n_links, g.component_id) for g in got) == Counter([*want, *((b[0], 0, b[0]) for b in bad)])
    assert all(g.kept == (g.vec_id == g.component_id) for g in got)
    assert near_vectors(df.filter("vec_id < 0")).count() == 0


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def likeness(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_bottom_k_fingerprints_of_edited_texts(spark):
    docs = documents(spark).filter("doc_id <> 35")  # the id that is stored twice
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in edited_digests(docs).collect()}
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        nxt, quarter = rows[(i + 1) % len(rows)][1], len(t) // 4
        changed = t[: len(t) - quarter] + nxt[:quarter]
        g = got[d]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        exact = max(len(shingle_set(x)) for x in (t, nxt, changed)) < 60
        assert g.near_edited == pytest.approx(likeness(t, changed), abs=1e-9 if exact else 0.2)
        assert g.near_next == pytest.approx(likeness(t, nxt), abs=1e-9 if exact else 0.2)
    twice = documents(spark).filter("doc_id = 35").collect()
    assert len(twice) == 2 and edited_digests(documents(spark)).filter("doc_id = 35").count() == 2
    assert edited_digests(empty(spark)).count() == 0
    alone = edited_digests(docs.filter("doc_id = 21")).first()
    assert alone.n_chars == 4 and alone.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(words(900, 11)), " ".join(words(700, 12))
    parts = spark.createDataFrame([(1, a), (1, b), (1, a), (2, ""), (3, "x")], "k int, t string").select("k", sketch(F.col("t")).alias("sketch"))
    got = {r.k: r.sketch for r in merged(parts, "k").collect()}
    union = shingle_set(a) | shingle_set(b)
    df = spark.createDataFrame([(got[1], a, b)], "m array<bigint>, a string, b string").select("m", sketch(F.col("a")).alias("a"), sketch(F.col("b")).alias("b"))
    r = df.select(distinct_shingles(F.col("m")).alias("n"), resemblance(F.col("m"), F.col("a")).alias("r"), containment(F.col("a"), F.col("m")).alias("c"), F.size("m").alias("s")).first()
    assert r.s == 128 and r.n == pytest.approx(len(union), rel=0.3)
    assert r.r == pytest.approx(len(shingle_set(a)) / len(union), abs=0.15) and r.c == 1.0
    assert 2 not in got and len(got[3]) == 1


def kept_of_brute_force(rows, candidate=lambda i, j: True):
    sets = [shingle_set(t) for _, t in rows]
    pairs = []
    for i, x in enumerate(sets):
        for j in range(i):
            shared = len(x & sets[j])
            if shared >= 0.8 * (len(x) + len(sets[j]) - shared) and candidate(i, j):
                pairs.append((i, j))
    root = roots(len(rows), pairs)
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == k) for k in set(root))


def test_families_around_the_limit_equal_checking_all_candidates(spark):
    r, count = random.Random(5), 300
    rows = []
    for f in range(3):
        base = [f"w{r.randrange(10**6)}" for _ in range(400)]
        for k in range(count // 3):
            near = base[:]
            for at in r.sample(range(400), r.randint(5, 7)):
                near[at] = f"n{r.randrange(10**6)}"
            rows.append((1000 * f + k, " ".join(near)))
    prints = [wide_print(shingles(t)) for _, t in rows]
    bits = np.unpackbits(np.array(prints).view(np.uint8), axis=1, bitorder="little")
    candidate = lambda i, j: (bits[i] != bits[j]).sum() <= 56
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept, want = sorted(x.doc_id for x in first_of_copies(df).collect()), kept_of_brute_force(rows, candidate)
    assert kept == want and len(want) < 250
    assert len(want) - len(kept_of_brute_force(rows)) <= 2
    # Components in many parts give the same groups, of every row.
    key = F.struct(F.lit(False).alias("a"), F.col("doc_id").alias("b"), F.col("doc_id").alias("c"))
    parts = copy_groups(df.select(key.alias("key"), "text"), part=6000).collect()
    assert len(parts) == len(rows) and sorted({x["first"]["b"] for x in parts}) == want


def test_parts_of_a_straddling_family_send_out_merging_links_only():
    """Each row against all others, at once and in parts, gives the clusters of all pairs with fewer links than rows."""
    r = np.random.default_rng(8)
    base = r.integers(0, 2**62, 120)
    sets = []
    for _ in range(900):
        x = base.copy()
        at = r.choice(120, r.integers(8, 18), replace=False)
        x[at] = r.integers(0, 2**62, len(at))
        sets.append(np.unique(x))
    prints = np.array([wide_print(x.view(np.uint64)) for x in sets])
    has = np.zeros((len(sets), 1 + np.unique(np.concatenate(sets)).size), np.float32)
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([len(x) for x in sets])[:-1])
    for i, c in enumerate(codes):
        has[i, c] = 1
    shared, size = has @ has.T, np.array([len(x) for x in sets])
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    near = (shared >= 0.8 * (size[:, None] + size - shared)) & (far <= 56)
    want = roots(len(sets), list(zip(*np.nonzero(np.triu(near, 1)))))
    own = np.arange(len(sets))
    links = spanning_links(prints, sets, own, own, 0.8)
    assert roots(len(sets), links) == want and len(links) < len(sets) and len(set(want)) > 20
    first = spanning_links(prints[:450], sets[:450], own[:450], own[:450], 0.8)
    label = np.array(roots(len(sets), first))
    rest = spanning_links(prints, sets, label, np.arange(450, 900), 0.8)
    assert roots(len(sets), [*first, *rest]) == want


@pytest.mark.parametrize("size", [33, 36, 45, 90, 180, 900])
def test_recall_of_bands_by_size(size):
    """Pairs just over the limit, over table sizes that take more bands."""
    r = np.random.default_rng(size)
    prints = []
    for _ in range(200):
        a = r.integers(0, 2**63, size, dtype=np.uint64)
        b = a.copy()
        n = int(size * 0.2 / 1.8)  # changed in both: similarity (size - n) / (size + n) >= 0.8
        b[:n] = r.integers(0, 2**63, n, dtype=np.uint64)
        prints += [wide_print(a), wide_print(b)]
    bits = np.unpackbits(np.array(prints).view(np.uint8), axis=1, bitorder="little")
    far = (bits[::2] != bits[1::2]).sum(axis=1) <= 56
    for rows in (1000, 10**7, 10**9):
        places = band_places(*bands_for(rows))
        met = np.any([(bits[::2, p] == bits[1::2, p]).all(axis=1) for p in places], axis=0)
        assert (met & far).mean() >= 0.9, (rows, (met & far).mean())


def test_short_copies_equal_comparing_all_pairs(spark):
    r = random.Random(6)
    rows = []
    for k in range(300):
        base = [f"w{r.randrange(10**6)}" for _ in range(9 + k % 25)]
        rows.append((2 * k, " ".join(base)))
        rows.append((2 * k + 1, " ".join(base[: len(base) - max(1, (len(base) - 4) // 5)])))
    for k in range(60):  # a line that many texts share
        rows.append((1000 + k, "one line that stands in very many short texts " + " ".join(f"v{r.randrange(10**6)}" for _ in range(k % 7))))
    want = kept_of_brute_force(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(x.doc_id for x in first_of_copies(df).collect()) == want and len(want) < 400
    short = df.filter("doc_id >= 0").collect()
    sets = [(x.doc_id, sorted(int(h) for h in shingles(x.text).view(np.int64))) for x in short]
    links = short_links(spark.createDataFrame(sets, "node bigint, set array<bigint>"), 0.8, limit=4).collect()
    at = {d: i for i, (d, _) in enumerate(rows)}
    root = roots(len(rows), [(at[x.a], at[x.b]) for x in links])
    copies = {x for x in range(len(rows)) if root[x] == x}
    assert sorted(rows[x][0] for x in copies if len(set(sets[x][1])) > 1) == [w for w in want if len(sets[at[w]][1]) > 1]
