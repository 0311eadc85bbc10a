"""As-of alignment of sparse marks and scores with the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.index import CHUNK, fill_forward, running_sums


def marks_before(stream: DataFrame, at: DataFrame, flag: str, chunk: int = CHUNK) -> DataFrame:
    """For each position in ``at.idx``: the newest flagged sample before it, and how many there are."""
    hit = F.when(F.col(flag), F.col("idx"))
    base = stream.select("idx", hit.alias("mark"))
    # Both carries run on the same chunks; the wanted positions are joined at the end.
    filled = fill_forward(running_sums(base, {"marks": F.col("mark").isNotNull().cast("long")}, chunk), ["mark"], chunk)
    prior = filled.select((F.col("idx") + 1).alias("idx"), F.col("mark_ffill").alias("last_mark"), F.col("marks").alias("earlier"))
    return at.join(prior, "idx", "left").withColumn("earlier", F.coalesce("earlier", F.lit(0).cast("long")))


def align_scores(
    stream: DataFrame, scores: DataFrame, score: str = "p", fill: float | None = 0.0, forward: bool = True, chunk: int = CHUNK
) -> DataFrame:
    """Continuous score: each sample takes the newest window score that ended at or before it.

    ``forward=False`` keeps the score on its end sample only and puts ``fill`` elsewhere.
    """
    at = scores.select(F.col("end_idx").alias("idx"), F.col(score).alias("_score"))
    joined = stream.join(at, "idx", "left")
    out = fill_forward(joined, ["_score"], chunk) if forward else joined.withColumn("_score_ffill", F.col("_score"))
    value = F.col("_score_ffill") if fill is None else F.coalesce("_score_ffill", F.lit(fill))
    return out.withColumn("score", value).drop("_score", "_score_ffill")


def offset_join(a: DataFrame, b: DataFrame, offset: int = 30, wa: float = 0.3, wb: float = 0.7) -> DataFrame:
    """``wa·a[i] + wb·b[i+offset]``; where b has run out, ``wa·a[i]`` alone."""
    shifted = b.select((F.col("i") - offset).alias("i"), F.col("score").alias("_b"))
    return a.join(shifted, "i", "left").select(
        "i", (F.lit(wa) * F.col("score") + F.coalesce(F.lit(wb) * F.col("_b"), F.lit(0.0))).alias("score")
    )


def map_scores(rows: DataFrame, scores: DataFrame, key: str = "window_id", score: str = "p", order: str = "end_idx") -> DataFrame:
    """Left map join; where a key has several scores the last one wins, and rows without one get null."""
    single = scores.groupBy(key).agg(F.max_by(score, order).alias(score))
    return rows.join(single, key, "left")
