"""Document fingerprints: bottom-k sketches of word-shingle hashes, with built-in functions only.

A sketch is the sorted array of the ``k`` smallest distinct shingle hashes of a text. Sketches of parts
merge into the sketch of the whole, and two sketches estimate resemblance (the share of common hashes
among the k smallest of both), containment and the number of distinct shingles; with fewer than k
shingles all three are exact.

Words are runs of other than ASCII white space, unchanged. A text with fewer words than a shingle is
one shingle of all its words; null, empty and white-space texts have the empty sketch, which resembles
another empty one fully and any other not at all. A very long text is one row's work, linear in its
length but for the sort. Equal texts have equal sketches, so repeated rows need no rule and equal hashes
count once; an empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tables import Table
from tidemark.operators.index import dense_index

WORDS, K = 5, 128
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """64-bit hash of each run of ``words`` words, in text order."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")

    def runs(h: Column) -> Column:
        n = F.size(h) - (words - 1)
        rest = lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)])
        return F.when(n > 1, F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))), rest)).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(split, lambda w: F.xxhash64(w)), runs)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def _lowest(a: Column, b: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both texts, 0 to 1."""
    return let(
        _lowest(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    )


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; 1 if ``a`` has none, null if none is among the lowest of both."""
    inside = let(
        _lowest(a, b, k),
        lambda u: let(F.array_intersect(u, a), lambda o: F.when(F.size(o) > 0, F.size(F.array_intersect(o, b)) / F.size(o))),
    )
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(inside)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def merged(parts: DataFrame, by: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """(``by``, ``sketch_col``): sketch of all parts of each key. A key's parts are cut to k hashes in every task before they meet."""
    hashes = parts.select(by, F.explode(sketch_col).alias("h")).distinct()
    lowest = hashes.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("h"))).filter(F.col("r") <= k)
    return lowest.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias(sketch_col))


def as_text(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness to each other and to the next document.

    The edited text ends with the start of the next document (ascending id; the first follows the
    last) in place of its last quarter. Rows that repeat an id follow each other as they are stored.
    Ids alone are sorted, with each text's length; a document then meets its place in a join on the
    row number, and sends the start that its predecessor needs, and its sketch, to that row. The
    texts are shuffled once. ``docs`` must be a repeatable plan such as a table scan.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = Table(dense_index(rows.select("row", "id", F.length("text").cast("long").alias("n")), "id", "row")).df
    total = order.count()
    before = order.select(((F.col("idx") + 1) % F.lit(max(1, total))).alias("idx"), F.col("row").alias("before"), (F.col("n") / 4).cast("long").alias("need"))
    place = Table(order.select("row", "idx").join(before, "idx").select("row", "before", "need")).df

    # Both uses take the same columns of the texts, so that they share one shuffle; the ids come last.
    own = rows.select("row", "text").join(place, "row").withColumn("sketch", sketch(F.col("text"), k, words))
    starts = own.select(F.col("before").alias("row"), F.expr("left(text, cast(need AS int))").alias("start"), F.col("sketch").alias("next"))
    n = F.length("text")
    both = own.select("row", "text", "sketch").join(starts, "row")
    edited = both.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) AS int))"), "start"))
    done = edited.select(
        "row", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "next", sketch(F.col("edited"), k, words).alias("changed")
    )
    return done.join(order.select("row", "id"), "row").select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next"), k).alias("near_next"),
    )
