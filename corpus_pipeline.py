"""Corpus pipeline: from raw documents to packed sequences, each stage written as Parquet and read again.

1. ``language``: fits a classifier on the labelled documents and drops texts in which no language can be
   told: those without a letter, and those of which no language holds and explains ``LEAST_SHARE`` of
   the letters (texts of unlearned scripts, gibberish). Texts too short to be judged stay.
   Where no document is labelled, nothing can be told apart and all stay.
2. ``near_dedup``: SimHash finds documents whose five-word shingles are alike to 0.8 or more; of each
   group that such links connect, the one with the smallest id stays.
3. ``substring_dedup``: words inside windows of 35 words that stand elsewhere too are removed from every
   place; texts without any stay as they are, and a text may become empty.
4. ``secrets``: values behind a credential word and a sign (``pwd: x``), passwords in addresses, access keys
   and long hex strings are masked, also those that are easily guessed; values that only prose introduces
   (``the token is x``) and those in authorisation headers are masked if they are hard to guess. The
   documents stay.
5. ``packing``: the texts are packed into sequences of 2048 tokens; one row per piece.

All stages but the last return the columns of their input, ``n_chars`` (where there is one) holding
the length of the text as the stage leaves it. Null texts have no letter and go in stage 1, and so do
empty ones; texts that stage 3 empties stay, and stage 5 gives them one piece. A null id stays a null id;
a group of copies is named by its smallest one. Very long texts are whole in every stage, one task's work.
Repeated rows are copies. Empty tables give empty results. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.languages import UNKNOWN, fit, predict
from tidemark.llm.packing import Limits, pack_texts
from tidemark.llm.registry import table
from tidemark.llm.relative_lz import remove_repeats
from tidemark.llm.secrets import mask
from tidemark.llm.simhash_copies import first_of_copies
from tidemark.llm.tables import Table, unused

LEAST_SHARE = 0.3


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, F.lit(True))
    if not model.langs:
        return docs
    lang, score, support = unused("lang_pred", docs), unused("lang_score", docs), unused("lang_support", docs)
    told = predict(docs, model, lang_name=lang, score_name=score, support_name=support)
    clear = (F.col(score) >= LEAST_SHARE) & F.coalesce(F.col(support) >= LEAST_SHARE, F.lit(True))
    return told.filter((F.col(lang) != UNKNOWN) & clear).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(remove_repeats(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mask(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_texts(docs, Limits(tokens=2048, segments=64, loss=2048))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: No stage but the second can be said in SQL; tests hold all of them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir)).df
    return STAGES[-1][1](spark, docs, sf_dir)
