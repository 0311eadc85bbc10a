"""Small tables with the awkward cases that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


def words(n: int, seed: int, pool: int = 400) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["th", "er", "an", "in", "ou", "st", "ed", "ly"]) for _ in range(r.randint(1, 3))) + r.choice(["", "", "", ",", "."]) for _ in range(n)]


def texts() -> list[str | None]:
    """Null, empty, white space, one word, copies, near copies, shared passages, repeats, odd letters, long."""
    passage = " ".join(words(60, 99))
    base = words(200, 1)
    near = base[:]
    near[100] = "changed"
    out: list[str | None] = [None, "", "  \n\t ", "Word", "Three little words", " ".join(base), " ".join(base), " ".join(near)]
    out += [f"{' '.join(words(40, 2))} {passage} {' '.join(words(30, 3))}", f"{passage}\n{' '.join(words(50, 4))}", f"{' '.join(words(35, 5))}\t{passage}"]
    out += [" ".join(["again"] * 100), " ".join(words(34, 6)), " ".join(words(35, 7)), " ".join(words(35, 7))]
    out += ["don't 'sup I'LL <|endoftext|> x<|startoftext|> <|endoftext|", "ΑΣ ΣΑΣ İstanbul é é à̀b", "日本語 12३४ ½ ⅷ 👍🏽 ﬁ ǅ", "a\x1cb \x00 c d e \u0085x", "x" * 700, "  two  spaces \n here  "]
    out += [" ".join(words(9000, 8)), " ".join(words(300, 9)) + " password=b7db7aa4a5fcc78305 tail"]
    return out


def documents(spark: SparkSession) -> DataFrame:
    """The texts under ids out of order, one row stored twice, and a column that operators use as a name inside."""
    rows = [(i * 7 % 101, t, "en", "src0", None, "x") for i, t in enumerate(texts())]
    rows.append(rows[5])
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("extra", "row")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
