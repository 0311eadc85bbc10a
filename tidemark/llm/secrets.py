"""Secret scans: three fixed patterns, and a guess-cost rating of values in credential contexts.

A value that follows a credential word (or stands in a URL or an authorisation header) is cut into
words, dates, repeats, keyboard walks and brute-force spans so that the guesses needed are fewest:
``best[i]`` is the least log10 of guesses for the first ``i`` characters, over all spans that end
there. A brute-force span may have any length and costs its characters' class sizes, so it is carried
along as a second state and the whole takes time linear in the value. Values that take at least
``10 ** least`` guesses become spans of kind ``guess`` unless a fixed pattern has them already;
weak ones ("password123", "qwertyuiop") do not. Words are a short fixed list of what passwords are made
of, then the ``CORPUS_WORDS`` most frequent words of all texts (a broadcast of a stated size). Repeats have
units of any length.

Positions are code points, ends exclusive. Null and empty texts have no spans. Rows are independent:
repeated rows, empty tables and other columns need no rule, and a very long text or value costs time
in proportion to its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe_trie import slices
from tidemark.llm.tables import Table

KINDS = ("assign", "access", "hex", "guess")
LEAST = 9.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

_KEY = r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|secret)[_-]?key|auth|authorization|credentials?)"
_VALUE = r"""[^\s"'`<>(){}\[\],;]"""
CONTEXTS = [
    re.compile(rf"""(?<![A-Za-z]){_KEY}["']?(?:\x20*+(?:=>|:=|[:=])\x20*+|(\x20is\x20))["'`]?(?P<value>{_VALUE}{{6,}}+)""", re.I | re.A),
    re.compile(r"(?<![A-Za-z])(?:bearer|basic)\x20+(?P<value>[A-Za-z0-9+/_.=~-]{6,}+)", re.I | re.A),
    re.compile(r"://[^\s:/@]++:(?P<value>[^\s:/@]{6,}+)@"),
]
_HINT = re.compile("pass|pwd|secret|token|key|auth|credential|bearer|basic")

#: Frequent words of passwords and placeholders, the most frequent first.
WORDS = """password admin welcome login master secret dragon monkey letmein sunshine princess football shadow iloveyou trustno
hello freedom whatever test user guest root changeme default example sample dummy placeholder your token key pass word none null true false
undefined insert here enter value my the this that some any for and not are api auth access private public service system server database
super demo temp local dev prod staging summer winter spring autumn love baby angel star money""".split()
#: Words of the corpus that count besides, the most frequent ones, of so many letters.
CORPUS_WORDS, SHORTEST, LONGEST = 20_000, 3, 20
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
#: Characters written for letters.
_LEET = str.maketrans("4@8310!$57", "aabeoiisst")
#: Rows of keys, and their columns.
_ROWS = ["`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./"]
_NEAR = {frozenset(p) for row in [*_ROWS, *("".join(c) for c in zip(_ROWS[0][1:], *_ROWS[1:]))] for p in zip(row, row[1:])}
_DATE = re.compile(r"(?=((?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d))(?=((?:19|20)\d\d)?)")
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")

#: log10 of what each further span multiplies guesses by, for trying the spans' order and kinds.
_SPAN = math.log10(4)


def _class_cost(c: str) -> float:
    return 1.0 if "0" <= c <= "9" else math.log10(26) if "a" <= c <= "z" or "A" <= c <= "Z" else math.log10(33)


def _z(s: str) -> list[int]:
    """For each place, how far ``s`` goes on there as at its start."""
    n = len(s)
    z, lo, hi = [0] * n, 0, 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def repeats(value: str) -> set[tuple[int, int, int]]:
    """(start, end, unit) of runs in which a unit of two or more characters is written at least twice, by halving (n log n).

    Every maximal run is among them; a run that crosses the middle of a part is found from there.
    """
    out: set[tuple[int, int, int]] = set()
    stack = [(0, len(value))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < 4:
            continue
        mid = (lo + hi) // 2
        stack += [(lo, mid), (mid, hi)]
        u, v = value[lo:mid], value[mid:hi]
        back, on = _z(u[::-1]), _z(v)
        over_v = _z(v + "\0" + value[lo:hi])  # how far v goes on at each place
        over_u = _z(u[::-1] + "\0" + value[lo:hi][::-1])  # how far u goes back from each end
        for unit in range(2, hi - lo):
            # The unit before the middle, or the one behind it, is written again.
            if unit <= len(u):
                left = min(back[unit] if unit < len(u) else 0, len(u) - unit)
                right = over_v[len(v) + 1 + len(u) - unit]
                if left + right >= unit:
                    out.add((mid - unit - left, min(mid + right, hi), unit))
            if unit <= len(v):
                left = over_u[len(u) + 1 + len(v) - unit]
                right = min(on[unit] if unit < len(v) else 0, len(v) - unit)
                if left + right >= unit:
                    out.add((max(mid - left, lo), mid + unit + right, unit))
    return out


def _spans(value: str, ranks: dict[str, int]) -> dict[int, list[tuple[int, float]]]:
    """For each end, the (start, log10 guesses) of words, dates, repeats and walks that end there."""
    out: dict[int, list[tuple[int, float]]] = {}
    low = value.lower()
    if len(low) != len(value):
        low = "".join(c.lower()[0] for c in value)
    plain = low.translate(_LEET)
    n = len(value)
    for i in range(n):
        for text, extra in ((low, 0.0), (plain, math.log10(2))) if plain != low else ((low, 0.0),):
            for j in range(i + 2, min(n, i + LONGEST) + 1):
                rank = ranks.get(text[i:j])
                if rank:
                    upper = 0.0 if value[i:j] == low[i:j] else math.log10(2 + j - i)
                    out.setdefault(j, []).append((i, math.log10(rank + 1) + extra + upper))
    for m in _DATE.finditer(value):
        out.setdefault(m.end(1), []).append((m.start(), math.log10(365 * 130) + 0.6 * any(c in m[1] for c in "-/._")))
    for m in _YEAR.finditer(value):
        out.setdefault(m.end(1), []).append((m.start(), math.log10(130)))
    # Maximal runs: equal characters, steps of one in the alphabet, neighbours on the keyboard.
    for kind, base in (("same", 0.0), ("step", 0.6), ("keys", 1.2)):
        start = 0
        for i in range(1, n + 1):
            a, b = low[i - 1], low[i] if i < n else ""
            if kind == "same":
                on = a == b
            elif kind == "step":
                on = b != "" and abs(ord(a) - ord(b)) == 1 and (i - start < 2 or ord(b) - ord(a) == ord(a) - ord(low[i - 2]))
            else:
                on = frozenset((a, b)) in _NEAR
            if not on:
                if i - start >= 3:
                    cost = _class_cost(value[start]) + math.log10(i - start) + base
                    out.setdefault(i, []).append((start, cost))
                start = i if kind != "step" or b == "" or abs(ord(a) - ord(b)) != 1 else i - 1
    # Units of any length that are written again and again.
    sums = [0.0]
    for c in value:
        sums.append(sums[-1] + _class_cost(c))
    least: dict[tuple[int, int], int] = {}  # a run counts with its smallest unit
    for i, j, size in repeats(value):
        least[i, j] = min(size, least.get((i, j), size))
    for (i, j), size in least.items():
        for start in range(i, min(i + size, j - 2 * size + 1)):
            times = (j - start) // size
            out.setdefault(start + times * size, []).append((start, sums[start + size] - sums[start] + math.log10(times)))
    return out


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """Least log10 of the guesses for ``value`` over all its segmentations; ``ranks``: places of words by frequency."""
    known = _spans(value, ranks)
    best, brute = 0.0, math.inf
    costs = [0.0]
    for i, c in enumerate(value, 1):
        brute = min(brute, best + (_SPAN if i > 1 else 0.0)) + _class_cost(c)
        best = brute
        for start, cost in known.get(i, ()):
            best = min(best, costs[start] + cost + (_SPAN if start else 0.0))
        costs.append(best)
    return best


def corpus_ranks(docs: DataFrame, text_col: str = "text", limit: int = CORPUS_WORDS) -> dict[str, int]:
    """Places of the fixed words and, behind them, of the most frequent words of all texts (runs of ASCII letters).

    At most ``limit`` words come to the driver: those at or above the least count that so few reach, ordered by
    count, then by word. Words that tie at a count too low for all of them are left out together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for _, texts in slices(batch.column(0)):
                for t in texts:
                    if t:
                        found.update(re.findall(r"[a-z]+", t.lower()))
            kept = [(w, n) for w, n in found.items() if SHORTEST <= len(w) <= LONGEST]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    ranks = dict(_RANK)
    if not limit:
        return ranks
    counted = Table(docs.select(text_col).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    size, least = F.floor(8 * F.log2("n")).cast("int"), 1
    for key in (size, F.col("n")):  # a few hundred sizes at most, then the counts down to the size that is too large
        groups = counted.df.filter(F.col("n") >= least).groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("lo"), F.max("n").alias("hi")).collect()
        room = limit
        for r in sorted(groups, reverse=True):
            room -= r["c"]
            if room < 0:
                least = r["lo"] if key is size else r["hi"] + 1
                break
        else:
            break
    for r in sorted(counted.df.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["word"])):
        ranks.setdefault(r["word"], len(ranks) + 1)
    counted.drop()
    return ranks


Span = tuple[str, int, int, int]  # kind, start, end, start of the value


def find_spans(text: str | None, least: float = LEAST, ranks: dict[str, int] = _RANK, weak: bool = False) -> list[Span]:
    """All spans by start, then kind. ``weak``: also values behind a sign or in an address that are easily guessed."""
    if not text:
        return []
    found: list[Span] = [("hex", m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    hinted = bool(_HINT.search(text.lower()))
    if hinted:
        found += [("assign", m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    base, seen = sorted((s[3], s[2]) for s in found), set()
    for context in CONTEXTS if hinted else CONTEXTS[2:] if "://" in text else ():
        for m in context.finditer(text):
            span = m.span("value")
            signed = weak and (context is CONTEXTS[2] or (context is CONTEXTS[0] and m[1] is None))
            if span not in seen and not any(a <= span[0] and span[1] <= b for a, b in base) and (signed or guess_cost(m["value"], ranks) >= least):
                seen.add(span)
                found.append(("guess", *span, span[0]))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str | None, mark: str = "<secret>", least: float = LEAST, weak: bool = False, ranks: dict[str, int] = _RANK) -> str | None:
    """``text`` with each secret value replaced; values that are easily guessed only if ``weak``."""
    parts, at = [], 0
    for kind, start, end, value in sorted(find_spans(text, least, ranks, weak), key=lambda s: (s[3], s[2])):
        if end <= at or (not weak and kind == "assign" and guess_cost(text[value:end], ranks) < least):
            continue
        if value >= at:
            parts += [text[at:value], mark]
        at = end
    return text if not parts else "".join([*parts, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, corpus_words: int = CORPUS_WORDS) -> DataFrame:
    """``id_col`` and ``spans``: an array of (kind, start, end, log10 guesses of the value)."""
    src = docs.select(id_col, text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, text_col, corpus_words))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [{"kind": k, "start": a, "end": b, "log10_guesses": guess_cost(t[v:b], ranks.value)} for k, a, b, v in find_spans(t, least, ranks.value)]
                for _, texts in slices(batch.column(1))
                for t in texts
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "spans"])

    id_type = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>")


def mask(docs: DataFrame, text_col: str = "text", corpus_words: int = CORPUS_WORDS) -> DataFrame:
    """``docs`` with the values of all spans masked in ``text_col``; nothing else changes.

    Values behind a sign (``pwd: x``) and passwords in addresses go however weak they are; those that only
    prose introduces (``the token is x``) and in authorisation headers go if they are hard to guess.
    """
    spot = docs.columns.index(text_col)
    ranks = docs.sparkSession.sparkContext.broadcast(corpus_ranks(docs, text_col, corpus_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t, weak=True, ranks=ranks.value) for _, some in slices(batch.column(spot)) for t in some]
            cols = [pa.array(texts, batch.schema[i].type) if i == spot else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def scan_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, counts of the fixed patterns, digest of their spans, and all spans as text."""
    found = scan(docs, id_col, text_col)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col,
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", text)).alias("spans"),
    )
