"""Registry of queries, the shared input frames, and the matching SQL prefix.

A query is a function ``(spark, sf_dir) -> DataFrame``; ``sql`` is the same answer in plain SQL
over the raw tables. Inputs are indexed and stored once per session and folder: indexing is an
ingestion step, and everything after it is a lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.index import pick_chunk
from tidemark.operators.intervals import flag_ordered
from tidemark.operators.windows import right_edge_label, window_ends
from tidemark.session import kept, materialise, on_delete
from tidemark.sources.adapters import catalogue_from_stream, events_as_stream, is_event

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_STORED: dict[tuple, DataFrame] = {}

SIZE, STEP = 60, 10
# Distances from the event centre, in samples.
FLAGS = {"gt_fwhm": (-2, 2), "gt_detection_win": (-12, -3), "gt_4xfwhm": (-10, 10)}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of a table's files, so that a rewritten table is another one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], object], keep: bool = False):
    """``build()``, once per application and state of the event table; ``keep`` holds it beyond a scratch scope."""
    key = (spark.sparkContext.applicationId, listing(spark, f"{sf_dir}/events.parquet"), name)
    if key not in _STORED:
        if keep:
            with kept():
                _STORED[key] = build()
        else:
            _STORED[key] = build()
    return _STORED[key]


@on_delete
def _forget(folder: str) -> None:
    for key, value in list(_STORED.items()):
        if isinstance(value, DataFrame) and any(folder.split(":")[-1] in f for f in value.inputFiles()[:1]):
            del _STORED[key]


def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed observation stream without event flags: the sorted parts, numbered as they are read."""
    return stored(spark, sf_dir, "raw", lambda: events_as_stream(table(spark, sf_dir, "events")), keep=True)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_from_stream(raw_stream(spark, sf_dir))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed observation stream with the three interval flags, stored in ``idx`` order."""

    def build():
        raw = raw_stream(spark, sf_dir)
        cut = pick_chunk(raw.count(), spark.sparkContext.defaultParallelism)
        return materialise(flag_ordered(raw, is_event(), FLAGS, cut))

    return stored(spark, sf_dir, "flagged", build, keep=True)


def chunk(spark: SparkSession, sf_dir: str) -> int:
    rows = stored(spark, sf_dir, "rows", lambda: stream(spark, sf_dir).count(), keep=True)
    return pick_chunk(rows, spark.sparkContext.defaultParallelism)


def scored(spark: SparkSession, sf_dir: str, omit: bool = False) -> DataFrame:
    """Scored windows: score ``p`` of the last sample, right-edge label, integer ``y``."""
    ends = wends(spark, sf_dir)
    label = right_edge_label(F.col("gt_detection_win"), F.col("gt_fwhm"))
    out = ends.select(
        "window_id", "start_idx", "end_idx", "sclk", "p", label.alias("label"), "gt_fwhm", "gt_detection_win"
    )
    if not omit:
        out = out.filter(F.col("label") != "Omit")
    return out.withColumn("y", (F.col("label") == "True").cast("int"))


def wends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_ends(stream(spark, sf_dir), SIZE, STEP)


def r6(e: Column | str, alias: str) -> Column:
    return F.round(F.col(e) if isinstance(e, str) else e, 6).alias(alias)


def big(e: Column | str, alias: str) -> Column:
    return (F.col(e) if isinstance(e, str) else e).cast("long").alias(alias)


# --- SQL over the raw tables -----------------------------------------------------------------

STREAM_SQL = """
ev AS (
  SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS idx, event_id, user_id AS channel, event_type,
         CAST(floor(epoch(ts)) AS BIGINT) AS sclk, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS sol,
         value AS pressure,
         CASE WHEN event_type <> 'view' THEN CAST(CAST(floor(value) AS BIGINT) % 61 AS DOUBLE) END AS hits,
         value / (value + 50.0) AS p
  FROM events),
cat AS (SELECT event_id AS vortex, sclk, idx AS centre FROM ev WHERE event_type = 'error' AND pressure >= 200),
marks AS (
  SELECT centre + o AS idx, bool_or(o BETWEEN -2 AND 2) AS f, bool_or(o BETWEEN -12 AND -3) AS d,
         bool_or(o BETWEEN -10 AND 10) AS x
  FROM cat, (SELECT unnest(range(-12, 11)) AS o) GROUP BY 1),
st AS (
  SELECT ev.*, coalesce(f, false) AS gt_fwhm, coalesce(d, false) AS gt_detection_win,
         coalesce(x, false) AS gt_4xfwhm,
         CASE WHEN hits IS NOT NULL THEN CASE WHEN hits >= 30 THEN 1 ELSE 0 END END AS pos_hit
  FROM ev LEFT JOIN marks USING (idx)),
wend AS (
  SELECT (idx - 59) // 10 AS window_id, idx - 59 AS start_idx, idx AS end_idx, sclk, p, pressure,
         gt_fwhm, gt_detection_win,
         CASE WHEN gt_detection_win THEN 'True' WHEN gt_fwhm THEN 'Omit' ELSE 'False' END AS label
  FROM st WHERE idx >= 59 AND (idx - 59) % 10 = 0),
sc AS (SELECT *, CASE WHEN label = 'True' THEN 1 ELSE 0 END AS y FROM wend WHERE label <> 'Omit')"""


def sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([STREAM_SQL.strip(), *[c.strip() for c in ctes]]) + "\n" + body.strip()


def q6(e: str, alias: str) -> str:
    return f"round({e}, 6) + 0.0 AS {alias}"


def i8(e: str, alias: str) -> str:
    return f"CAST({e} AS BIGINT) AS {alias}"
