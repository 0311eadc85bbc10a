"""Language identification of mixed texts: script ranges, per-word scores, Viterbi spans.

A model holds, for each learned language, how often letter groups (2 and 3 letters of words with their
borders, and whole words) occur, and which scripts it is written in. A word's script narrows the
candidates; each candidate's score is its log-likelihood against the candidates' mean. Over the words
of a text, Viterbi with a penalty for each change of language labels every word, so single foreign
words do not break a span and longer passages do. The text's language is the one with most labelled
letters; the score is its share of them.

The support, if asked for, is the share of all letters that stand in words of the winner which it can
explain: a learned script, and letter groups that are on average likelier under it than if its letters
were drawn evenly (groups it was not shown count as unseen). Texts of unlearned scripts and gibberish
have next to none. A language learned from fewer than ``ENOUGH`` letter groups explains all words of its
scripts, as most groups are unseen then. Texts of fewer than ``FEW`` letters cannot be judged; their
support is null.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the language first in
alphabetical order. Rows are independent when predicting, so repeated rows need no rule; an empty
table gives an empty result, and where no row is labelled, nothing is learned and all texts are ``und``.
Very long texts take time in proportion to their words. Other columns are not read.

The classifier is fitted on a bounded sample: ``per_lang`` labelled rows of each language in
expectation, chosen by a hash of the row's id, for the ``labels`` most frequent languages. The model that
every task gets is bounded by ``GRAMS`` letter groups, fewer if there are so many languages that it would
pass ``CELLS`` numbers. A letter is a character of a letter category (``²``, ``½`` and ``Ⅷ`` are none).
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe_trie import slices

UNKNOWN = "und"
#: Sampled rows per language and letter groups in the model.
PER_LANG, GRAMS = 1_500, 120_000
#: Languages that are learned at most, the most frequent ones, and numbers (groups times languages) of a model.
LABELS, CELLS = 1_000, 24_000_000
#: What a change of language costs, the limit of one word's score, and the words that a task remembers.
SWITCH, WORD_CAP, MEMO = 14.0, 6.0, 120_000
#: Letters that a text needs for its support to be judged, and the share of a language's letter groups that a letter of its needs.
FEW, RARE = 20, 1e-4
#: Letter groups in a language's sample (about 18,000 words) from which unseen groups speak against a word.
ENOUGH = 200_000

#: First code points of script ranges (others are "other").
_SCRIPTS = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"),
    (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"), (0xA80, "gujarati"), (0xB00, "other"), (0xB80, "tamil"), (0xC00, "telugu"),
    (0xC80, "kannada"), (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = [s for s, _ in _SCRIPTS]
_LETTERS = regex.compile(r"\p{L}+")


def script(word: str) -> str:
    """Script of a word's first letter."""
    return _SCRIPTS[bisect.bisect_right(_STARTS, ord(word[0])) - 1][1]


def grams(word: str) -> list[str]:
    """Pairs and triples of letters of a lower-case word with borders; the word itself, marked, is one more."""
    w = f"^{word}$"
    return [w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)] + ["=" + word]


@dataclass
class Model:
    langs: list[str]
    scripts: dict[str, np.ndarray]  # script: which languages use it
    places: dict[str, int]  # letter group: its row in scores
    scores: np.ndarray  # log-likelihoods by language
    words: np.ndarray | None = None  # which rows of scores are whole words
    unseen: np.ndarray | None = None  # log-likelihood of a group that was not seen, by language
    even: np.ndarray | None = None  # least mean log-likelihood of a word's groups, by language


def _even(names: list[str], groups: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """By language, the mean log-likelihood of pairs and triples of letters drawn evenly, or half way from unseen to typical groups."""
    total = groups.sum(axis=0) + 1
    size = np.array([0 if g[0] == "=" else len(g) for g in names])
    held: dict[str, np.ndarray] = {}
    for g, row, n in zip(names, groups, size):
        if n == 2:
            held[g[0]] = held.get(g[0], 0) + row
    letters = np.maximum(sum(((row >= RARE * total).astype(np.int64) for row in held.values()), np.zeros(len(total), np.int64)), 1)
    shares = [np.maximum(groups[size == n].sum(axis=0), 1) / total for n in (2, 3)]
    even = np.log(shares).sum(axis=0) / 2 - 2.5 * np.log(letters)
    some = groups[size > 0]
    typical = (some * np.log((some + 0.5) / total)).sum(axis=0) / np.maximum(some.sum(axis=0), 1)
    return np.where(total < ENOUGH, -np.inf, np.maximum(even, (unseen + typical) / 2))


def _gram_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: dict[str, Counter] = {}
            langs = batch.column(1).to_pylist()
            for start, texts in slices(batch.column(0)):
                for k, t in enumerate(texts, start):
                    words.setdefault(langs[k], Counter()).update(_LETTERS.findall(t.lower()))
            for lang, counted in words.items():
                found: Counter = Counter()
                for w, n in counted.items():
                    for g in grams(w):
                        found[g] += n
                    found["#" + script(w)] += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys(), pa.string()), pa.array([lang] * len(found), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "lang", "n"]
                )

    counted = labelled.select(text_col, lang_col).mapInArrow(run, "gram string, lang string, n bigint")
    return counted.groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, limit: int = GRAMS, labels: int = LABELS) -> Model:
    """Learn from the labelled rows for which ``use`` holds."""
    rows = docs.filter(use & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(labels).collect()}
    limit = min(limit, CELLS // max(1, len(sizes)))
    if not sizes:
        return Model([], {}, {}, np.zeros((0, 0), np.float32))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))])
    place = F.pmod(F.xxhash64(F.lit("sample"), id_col, F.xxhash64(text_col)), F.lit(1 << 30)) / float(1 << 30)
    counted = _gram_counts(rows.filter(place < share[F.col(lang_col)]), text_col, lang_col)
    kept = counted.groupBy("gram").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    top = kept.filter("all >= 3 OR gram LIKE '#%'").orderBy(F.desc("all"), "gram").limit(limit).collect()

    langs = sorted(sizes)
    spot = {lang: i for i, lang in enumerate(langs)}
    counts = np.zeros((len(top), len(langs)))
    for row, r in zip(counts, top):
        for lang, n in r["by"].items():
            row[spot[lang]] = n
    names = [r["gram"] for r in top]
    marks = np.array([g[0] == "#" for g in names], bool)
    written = counts[marks].sum(axis=0)
    scripts = {g[1:]: row >= 0.01 * np.maximum(written, 1) for g, row, m in zip(names, counts, marks) if m}
    groups = counts[~marks]
    scores = np.log((groups + 0.5) / (groups.sum(axis=0) + 1)).astype(np.float32)
    places = {g: i for i, g in enumerate(g for g, m in zip(names, marks) if not m)}
    unseen = np.log(0.5 / (groups.sum(axis=0) + 1))
    return Model(langs, {s: use for s, use in scripts.items() if use.any()}, places, scores, np.array([g[0] == "=" for g in places], bool), unseen, _even(list(places), groups, unseen))


class Labeller:
    """Per-word scores and Viterbi labels under one model; words are scored once per task."""

    def __init__(self, model: Model, support: bool = False):
        self.model, self.support = model, support
        names = sorted(model.scripts)
        self.script_at = {s: i for i, s in enumerate(names)}
        self.uses = np.array([model.scripts[s] for s in names], bool).reshape(len(names), len(model.langs))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1024, np.int64)
        self.explained = np.zeros(self.rows.shape, np.int32)

    def learn(self, pieces: list[str]) -> None:
        """Score new pieces of lower-case text and count their letters."""
        base, n = len(self.known), len(pieces)
        if base + n > len(self.rows):
            size = 2 * (base + n)
            self.rows, old = np.zeros((size, self.rows.shape[1]), np.float32), self.rows
            self.letters, old_letters = np.zeros(size, np.int64), self.letters
            self.rows[:base], self.letters[:base] = old[:base], old_letters[:base]
            self.explained, old = np.zeros(self.rows.shape, np.int32), self.explained
            self.explained[:base] = old[:base]
        places, script_at = self.model.places, self.script_at
        flat: list[int] = []
        sizes: list[int] = []
        owner: list[int] = []
        scripts: list[int] = []
        lengths: list[int] = []
        for i, p in enumerate(pieces, base):
            words = [p] if p.isalpha() else _LETTERS.findall(p)
            for w in words:
                self.letters[i] += len(w)
                at = script_at.get("latin" if w[0] < "\u0370" else script(w))
                if at is None:
                    continue
                found = [places[g] for g in grams(w) if g in places]
                if found:
                    flat += found
                    sizes.append(len(found))
                    owner.append(i)
                    scripts.append(at)
                    lengths.append(len(w))
        self.known.update(zip(pieces, range(base, base + n)))
        if not owner:
            return
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        sums = np.add.reduceat(self.model.scores[flat], starts, axis=0) / 2
        use = self.uses[scripts]
        mean = (sums * use).sum(axis=1, keepdims=True) / use.sum(axis=1, keepdims=True)
        np.add.at(self.rows, owner, np.where(use, np.clip(sums - mean, -WORD_CAP, WORD_CAP), -WORD_CAP))
        if not self.support:
            return
        model, n = self.model, np.array(lengths)[:, None]
        whole = model.words[flat]
        seen = np.array(sizes)[:, None] - np.add.reduceat(whole.astype(np.int64), starts)[:, None]
        likely = np.add.reduceat(np.where(whole[:, None], 0, model.scores[flat]), starts, axis=0) + (2 * n + 1 - seen) * model.unseen
        np.add.at(self.explained, owner, np.where(use & (likely >= model.even * (2 * n + 1)), n, 0))

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text, the language number of each of its pieces with letters, their letters, and how many of them that language explains."""
        if len(self.known) > MEMO:
            self._clear()
        if not self.model.langs:
            return [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(texts)
        split = [t.lower().split() if t else [] for t in texts]
        new: set[str] = set()
        new.update(*split)
        new -= self.known.keys()
        if new:
            self.learn(sorted(new))
        get, letters, docs = self.known.__getitem__, self.letters, []
        for pieces in split:
            at = np.fromiter(map(get, pieces), np.int64, len(pieces))
            docs.append(at[letters[at] > 0])
        labels = viterbi([self.rows[at] for at in docs])
        return [(lab, letters[at], self.explained[at, lab]) for lab, at in zip(labels, docs)]


def viterbi(scores: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """Best label of every row of each score matrix; one step handles all texts that are that long."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    lengths = np.array([len(scores[i]) for i in order])
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(scores)
    if not len(lengths) or not lengths[0]:
        return out
    langs = scores[order[0]].shape[1]
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts longer than t
    first = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty((int(first[-1]), langs), np.float32)  # step by step
    for k, i in enumerate(order):
        flat[first[: lengths[k]] + k] = scores[i]
    moved = np.zeros(flat.shape, bool)
    source = np.zeros(len(flat), np.int32)
    v = flat[: active[0]].astype(np.float64)
    ends = np.zeros(len(order), np.int32)
    for t in range(1, steps + 1):
        a = active[t] if t < steps else 0
        if a < len(v):
            ends[a : len(v)] = v[a:].argmax(1)
            v = v[:a]
        if not a:
            break
        best = v.argmax(1)
        enter = v[np.arange(a), best] - switch
        jump = v < enter[:, None]
        moved[first[t] : first[t] + a] = jump
        source[first[t] : first[t] + a] = best
        v = np.where(jump, enter[:, None], v) + flat[first[t] : first[t] + a]
    label = ends
    back = np.empty(len(flat), np.int32)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        rows = slice(first[t], first[t] + a)
        back[rows] = label[:a]
        if t:
            jump = moved[rows][np.arange(a), label[:a]]
            label[:a] = np.where(jump, source[rows], label[:a])
    for k, i in enumerate(order):
        out[i] = back[first[: lengths[k]] + k]
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", spans_name: str | None = None, support_name: str | None = None) -> DataFrame:
    """``docs`` with the predicted language, its score and, if named, the spans as (lang, pieces, letters) and the support."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spot = docs.columns.index(text_col)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("pieces", pa.int64()), ("letters", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, support_name is not None)
        langs = labeller.model.langs
        for batch in batches:
            names: list[str] = []
            shares: list[float] = []
            spans: list[list[dict]] = []
            supports: list[float | None] = []
            for _, texts in slices(batch.column(spot), 3_000_000):
                for labels, letters, explained in labeller.label(texts):
                    if not len(labels):
                        names.append(UNKNOWN)
                        shares.append(0.0)
                        spans.append([])
                        supports.append(None)
                        continue
                    by = np.bincount(labels, weights=letters, minlength=len(langs))
                    k = int(by.argmax())
                    names.append(langs[k])
                    shares.append(float(by[k] / by.sum()))
                    supports.append(float(explained[labels == k].sum() / by.sum()) if by.sum() >= FEW else None)
                    if spans_name:
                        cut = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
                        spans.append([{"lang": langs[labels[a]], "pieces": int(b - a), "letters": int(letters[a:b].sum())} for a, b in zip(cut, cut[1:])])
            cols = [*batch.columns, pa.array(names, pa.string()), pa.array(shares, pa.float64())]
            if spans_name:
                cols.append(pa.array(spans, span_type))
            if support_name:
                cols.append(pa.array(supports, pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, names=schema_names)

    schema = T.StructType([*docs.schema.fields, T.StructField(lang_name, T.StringType()), T.StructField(score_name, T.DoubleType())])
    if spans_name:
        span = T.StructType().add("lang", T.StringType()).add("pieces", T.LongType()).add("letters", T.LongType())
        schema = schema.add(spans_name, T.ArrayType(span))
    if support_name:
        schema = schema.add(support_name, T.DoubleType())
    schema_names = schema.names
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows of the test fold: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; the held-out fold is not learned from."""
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
