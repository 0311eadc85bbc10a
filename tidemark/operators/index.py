"""Position on a distributed frame: dense index, halo frames, carry-in, renumbering.

Everything the engine does is phrased in sample *position*. ``dense_index`` pays for one range
sort, once, at ingestion. After that ``floor(idx / chunk)`` cuts the stream into equal pieces, so
no later step can be skewed by how the clock values are spread.

The summaries that travel between chunks hold one row per chunk (or per range partition); those
are the only frames that ever meet in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.attach import attach
from tidemark.session import materialise

CHUNK = 1 << 18
PART, ROW = "_part", "_row"


def _columns(keys) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def ordered_parts(df: DataFrame, *keys, partitions: int | None = None) -> DataFrame:
    """Range-sort by ``keys`` and store the result with its partition number and row number.

    Range bounds come from Spark's own sample over the whole key, so a clock value that holds
    a large share of the rows is split as long as the key ends in a tie breaker. The frame is
    written before partition numbers are read back: a re-run of the sort could draw other bounds.
    """
    cols = _columns(keys)
    ranged = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    numbered = ranged.sortWithinPartitions(*cols).select(
        "*",
        F.spark_partition_id().alias(PART),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias(ROW),
    )
    return materialise(numbered)


def _prefix(summary: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Exclusive running sums over a per-chunk summary (one row per chunk)."""
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(by, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_carry_{c}") for c in columns])


def dense_index(df: DataFrame, *keys, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """Add the 0-based global position of each row in ``keys`` order. Keys must be unique."""
    stored = ordered_parts(df, *keys, partitions=partitions)
    counts = stored.groupBy(PART).agg(F.count(F.lit(1)).alias("n"))
    # One row per range partition, so its size is set by the partition count, not by the data.
    offsets = F.broadcast(_prefix(counts, PART, ["n"]))
    return (
        stored.join(offsets, PART)
        .withColumn(name, F.col("_carry_n") + F.col(ROW))
        .drop(PART, ROW, "_carry_n")
    )


def chunk_of(position, chunk: int) -> Column:
    """Number of the ``chunk``-long piece that holds a position (integer arithmetic, floor for negatives)."""
    p = _columns([position])[0].cast("long")
    return F.call_function("div", p - F.pmod(p, F.lit(chunk)), F.lit(chunk))


def pick_chunk(rows: int, tasks: int) -> int:
    """Chunk length that gives every task a few chunks and keeps summaries small."""
    return int(min(max(rows // max(1, 4 * tasks), 2048), 1 << 20))


def halo(df: DataFrame, before: int, after: int = 0, chunk: int = CHUNK, by: str = "idx") -> DataFrame:
    """Assign rows to chunks and copy border rows to the neighbours whose frames reach them.

    Adds ``_chunk`` and ``_own`` (false on copies). Inside a chunk every own row sees its full
    ``[-before, +after]`` frame, so analytic functions need no global order.
    """
    pos = F.col(by)
    first = F.greatest(F.lit(0).cast("long"), chunk_of(pos - after, chunk))
    last = chunk_of(pos + before, chunk)
    return df.select("*", F.explode(F.sequence(first, last)).alias("_chunk")).withColumn(
        "_own", chunk_of(pos, chunk) == F.col("_chunk")
    )


def in_chunk(by: str = "idx"):
    return Window.partitionBy("_chunk").orderBy(by)


def trailing(n: int, by: str = "idx"):
    return in_chunk(by).rowsBetween(-(n - 1), 0)


def centred(h: int, by: str = "idx"):
    return in_chunk(by).rowsBetween(-h, h)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_chunk")


def rolling(
    df: DataFrame, exprs: dict[str, Column], before: int, after: int = 0, chunk: int = CHUNK, by: str = "idx"
) -> DataFrame:
    """Evaluate window expressions (built on :func:`trailing`, :func:`centred`, …) with halo rows."""
    out = halo(df, before, after, chunk, by)
    return drop_halo(out.select("*", *[e.alias(n) for n, e in exprs.items()]))


class Prefix:
    """Wide trailing frames from running sums inside a chunk: constant work per row.

    A bounded frame is re-read for every row, which for 500 samples means 500 updates each. Here
    the sum of the last ``n`` values is the difference of two running sums. Values should be
    centred (differences, or about a local value), since the variance is a difference too.
    Call :meth:`prepare` on a frame with halo rows, then use the other methods on its result.
    """

    def __init__(self, column: str, squares: bool = False, by: str = "idx"):
        self.column, self.squares, self.by = column, squares, by
        self._s1, self._s2, self._n = f"_p1_{column}", f"_p2_{column}", f"_pn_{column}"

    def prepare(self, df: DataFrame) -> DataFrame:
        upto = in_chunk(self.by).rowsBetween(Window.unboundedPreceding, 0)
        c = F.col(self.column)
        out = [F.sum(c).over(upto).alias(self._s1), F.count(c).over(upto).alias(self._n)]
        if self.squares:
            out.append(F.sum(c * c).over(upto).alias(self._s2))
        return df.select("*", *out)

    def _last(self, name: str, n: int) -> Column:
        return F.col(name) - F.coalesce(F.lag(name, n).over(in_chunk(self.by)), F.lit(0))

    def mean(self, n: int) -> Column:
        return F.try_divide(self._last(self._s1, n), self._last(self._n, n))

    def std(self, n: int) -> Column:
        """Population deviation of the last ``n`` values."""
        k, m = self._last(self._n, n), self.mean(n)
        return F.sqrt(F.greatest(F.try_divide(self._last(self._s2, n), k) - m * m, F.lit(0.0)))


def extreme(fn, column: str, n: int, by: str = "idx", inner: int = 8) -> tuple[Column, Column]:
    """Trailing minimum or maximum over ``n`` rows in two short steps.

    Returns the expression for a helper column ``_x_<fn>_<column>`` (extreme of the last ``inner``
    rows) and the expression that combines its lags; ``n`` must be at least ``inner``.
    """
    name = f"_x_{fn.__name__}_{column}"
    pick = F.least if fn is F.min else F.greatest
    lags = sorted({*range(0, n - inner, inner), n - inner})
    w = in_chunk(by)
    return fn(column).over(trailing(inner, by)).alias(name), pick(*[F.lag(name, k).over(w) if k else F.col(name) for k in lags])


def rolling_mean(df: DataFrame, column: str, n: int, name: str, chunk: int = CHUNK, by: str = "idx") -> DataFrame:
    """Mean of the last ``n`` rows (fewer at the start of the stream)."""
    near = halo(df, n - 1, chunk=chunk, by=by)
    first = F.first(column).over(in_chunk(by))
    near = near.withColumn("_origin", first).withColumn("_d", F.col(column) - F.col("_origin"))
    prefix = Prefix("_d", by=by)
    out = prefix.prepare(near).select(*df.columns, "_own", "_chunk", (F.col("_origin") + prefix.mean(n)).alias(name))
    return drop_halo(out)


def running_sums(df: DataFrame, columns: dict[str, Column], chunk: int = CHUNK, by: str = "idx") -> DataFrame:
    """Inclusive running sums in ``by`` order over a frame keyed by dense position."""
    parts = df.select("*", chunk_of(by, chunk).alias("_chunk"), *[e.alias(f"_v_{n}") for n, e in columns.items()])
    return _carry_sums(parts, list(columns), "_chunk", by)


def running_sums_by(df: DataFrame, keys, columns: dict[str, Column]) -> DataFrame:
    """Inclusive running sums in the order of arbitrary unique ``keys``."""
    stored = ordered_parts(df.select("*", *[e.alias(f"_v_{n}") for n, e in columns.items()]), *keys)
    return _carry_sums(stored, list(columns), PART, ROW).drop(ROW)


def _carry_sums(parts: DataFrame, names: list[str], chunk: str, by: str) -> DataFrame:
    totals = parts.groupBy(chunk).agg(*[F.sum(f"_v_{n}").alias(n) for n in names])
    w = Window.partitionBy(chunk).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(f"_v_{n}").over(w).alias(f"_s_{n}") for n in names])
    joined = local.join(_prefix(totals, chunk, names), chunk)
    keep = [c for c in parts.columns if c != chunk and not c.startswith("_v_")]
    return joined.select(
        *keep, *[(F.coalesce(F.col(f"_s_{n}"), F.lit(0)) + F.col(f"_carry_{n}")).alias(n) for n in names]
    )


def fill_forward(df: DataFrame, columns: list[str], chunk: int = CHUNK, by: str = "idx") -> DataFrame:
    """Newest non-null value at or before each row, across chunk borders; result ``<col>_ffill``."""
    parts = df.withColumn("_chunk", chunk_of(by, chunk))
    newest = parts.groupBy("_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(by))).alias(c) for c in columns]
    )
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = newest.select("_chunk", *[F.last(c, True).over(before).alias(f"_in_{c}") for c in columns])
    w = in_chunk(by).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.last(c, True).over(w).alias(f"_l_{c}") for c in columns])
    return local.join(carry, "_chunk").select(
        *df.columns, *[F.coalesce(f"_l_{c}", f"_in_{c}").alias(f"{c}_ffill") for c in columns]
    )


def renumber(df: DataFrame, name: str, *ties: str, by: str = "idx", chunk: int = CHUNK) -> DataFrame:
    """Dense 0-based number of a subset of positions, in ``by`` order.

    The chunk is a pure function of the position, so nothing has to be stored first.
    """
    parts = df.withColumn("_chunk", chunk_of(by, chunk))
    counts = parts.groupBy("_chunk").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("_chunk").orderBy(by, *ties)
    return (
        parts.withColumn("_rn", F.row_number().over(w) - 1)
        .join(_prefix(counts, "_chunk", ["n"]), "_chunk")
        .withColumn(name, F.col("_carry_n") + F.col("_rn"))
        .drop("_chunk", "_rn", "_carry_n")
    )


def exact_percentiles(df: DataFrame, value: str, qs: list[float], by: str | None = None) -> DataFrame:
    """Linear-interpolation percentiles without gathering the values in one task.

    Distinct values are range-sorted with their counts; the two neighbours of each rank are then
    picked by their running count. Returns ``[by,] q, value``.
    """
    group = F.col(by) if by else F.lit(0)
    counted = df.filter(F.col(value).isNotNull()).groupBy(group.alias("_g"), F.col(value).alias("_x")).agg(
        F.count(F.lit(1)).alias("_c")
    )
    ranked = running_sums_by(counted, ["_g", "_x"], {"_cum": F.col("_c")})
    # A group's values are consecutive, so its own counts begin where its first value's do.
    start = F.min(F.col("_cum") - F.col("_c"))
    sizes = ranked.groupBy("_g").agg(start.alias("_start"), (F.max("_cum") - start).alias("_n"))
    ranks = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    cells = [
        F.struct(F.lit(float(q)).alias("q"), r.alias("_r"), edge(r).alias("_k"), F.col("_start"))
        for q, r in zip(qs, ranks)
        for edge in (F.floor, F.ceil)
    ]
    picks = sizes.select("_g", F.array_distinct(F.array(*cells)).alias("_few"))
    # Each row keeps the ranks it holds. Many groups meet their picks in an equi-join; without groups there is one row to attach.
    both = ranked.join(picks, "_g") if by else attach(ranked, picks.select("_few"))
    holds = F.filter(
        "_few",
        lambda k: (F.col("_cum") - k["_start"] > k["_k"]) & (F.col("_cum") - k["_start"] - F.col("_c") <= k["_k"]),
    )
    hit = both.select("_g", "_x", F.inline(holds))
    out = hit.groupBy("_g", "q").agg(
        F.min_by("_x", "_k").alias("_lo"), F.max_by("_x", "_k").alias("_hi"), F.first("_r").alias("_r")
    )
    frac = F.col("_r") - F.floor("_r")
    out = out.select(F.col("_g"), "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias(value))
    return out.withColumnRenamed("_g", by) if by else out.drop("_g")
