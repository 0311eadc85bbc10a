from __future__ import annotations

import datetime as dt
import random
import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from check import canon
from tidemark import schemas
from tidemark.functions.scalars import catalogue_seconds, strict_label
from tidemark.operators import audit, setops, splits
from tidemark.plans.catalog import load
from tidemark.sources import links, readers, sinks
from tidemark.streaming import continuous, stateful
from tidemark.streaming.source import event_stream, run_available, run_to_end

QUERIES, ORACLES = load()


def folder() -> str:
    return tempfile.mkdtemp(prefix="tidemark-test-")


def test_clean_load_drops_bad_clocks(spark):
    rows = [("5", 1.0, "True"), ("x", 2.0, "0"), (None, 3.0, None), ("7.0", 4.0, "1")]
    df = spark.createDataFrame(rows, "SCLK string, PRESSURE double, gt_detection_win string").withColumn("gt_fwhm", F.lit("false"))
    got = sorted((r["SCLK"], r["gt_detection_win"]) for r in readers.clean(readers.validated(df)).collect())
    assert got == [(5, True), (7, True)]
    assert tuple(readers.clean_report(df).head()) == (4, 2, 2)
    with pytest.raises(ValueError, match="missing"):
        readers.validated(df.drop("PRESSURE"))
    with pytest.raises(ValueError, match="empty"):
        readers.validated(df.limit(0))


def test_csv_round_trip_keeps_nulls(spark):
    path = folder() + "/c"
    row = [(15, 16, 18, 50.0, 3.0, 0.42, 0.04, 61.0, 14.0, None, None, "0015 16:18:50", 668288145)]
    sinks.write_csv(spark.createDataFrame(row, schemas.CATALOGUE), path)
    back = readers.read_csv(spark, path, schemas.CATALOGUE)
    assert back.head()["RDS"] is None
    assert back.select(catalogue_seconds(F.col("meda_format_time"))).head()[0] == 15 * 86400 + 16 * 3600 + 18 * 60 + 50


def test_fallback_and_cache(spark):
    base = folder()
    spark.range(5).write.parquet(base + "/b")
    assert readers.read_first_available(spark, [base + "/a", base + "/b"]).count() == 5
    with pytest.raises(FileNotFoundError):
        readers.read_first_available(spark, [base + "/a"])
    built = []

    def build():
        built.append(1)
        return spark.range(7)

    for _ in range(2):
        assert sinks.cached_features(spark, base + "/f", 7, build).count() == 7
    assert len(built) == 1


def test_latest_run(spark):
    path = folder() + "/runs"
    for run, ts, f1 in (("a", 1, 0.9), ("b", 2, 0.4)):
        sinks.record_metrics(spark.createDataFrame([("m", 0.5, f1)], "model string, threshold double, f1 double"), path, run, ts, "val")
    rows = sinks.latest_run(spark.read.parquet(path)).collect()
    assert [(r["run_id"], r["value"]) for r in rows] == [("b", 0.4)]
    assert sinks.best_recorded_threshold(spark.read.parquet(path)).head()["value"] == 0.9


def test_strict_label_stops_on_unknown_text(spark):
    df = spark.createDataFrame([("True",), ("maybe",)], "label string")
    with pytest.raises(Exception, match="unknown label"):
        df.select(strict_label(F.col("label"))).collect()


def test_links(spark):
    html = """<a href="2004/">x</a> <A class='q' HREF='b.xml'>y</a> <a href=c.dat>z</a> <a name="n">no</a>
    <a href="../">up</a><a href="/abs">a</a><a href="?C=N">s</a><a href="icons/i.gif">i</a><a href="">e</a>
    <!-- <a href="hidden.xml">h</a> --><script>var s = '<a href="js.xml">';</script><a data-x="1>2" href="d.csv?a=1&amp;b=2">w</a>"""
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [r["href"] for r in links.child_links(pages).orderBy("pos").collect()]
    assert got == ["2004/", "b.xml", "c.dat", "d.csv?a=1&b=2"]
    assert [r["href"] for r in links.child_links(pages, years=["2005"], extensions=[".XML"]).collect()] == ["b.xml"]


def test_splits_of_published_sizes(spark):
    """The 70/3.5/15 split of the published stream length gives its published parts."""
    n = spark.createDataFrame([(3590167,)], "_n long")
    df = spark.range(3590167).withColumnRenamed("id", "idx")
    got = {r["split"]: r["count"] for r in splits.position_split(df, rows=n).groupBy("split").count().collect()}
    assert got["train"] == int(3590167 * 0.70)
    assert got["val"] == int(3590167 * (0.70 + 0.035 + 0.15)) - int(3590167 * (0.70 + 0.035))


def test_audits_on_planted_faults(spark):
    rows = [(i, 1000 + i - (i == 50) * 5, float(i % 7), i % 2 == 0, None if i < 3 else 1.0) for i in range(100)]
    s = spark.createDataFrame(rows, "idx long, sclk long, pressure double, gt_detection_win boolean, extra double")
    q = audit.row_quality(s, ["pressure", "extra"], chunk=16).head()
    assert (q["extra_nulls"], q["sclk_falls"], q["repeated_clocks"]) == (3, 1, 0)
    warned = {(r["kind"], r["subject"]) for r in audit.data_warnings(s, ["pressure", "extra"], chunk=16).collect()}
    assert warned == {("missing", "extra")}
    flat = {(r["kind"], r["subject"]) for r in audit.matrix_warnings(s.withColumn("k", F.lit(2.0)), ["pressure", "k"]).collect()}
    assert ("constant", "k") in flat
    assert setops.schema_diff(s, s.drop("extra"))["only_left"] == ["extra"]


def write_events(spark, files: int, shuffle: bool) -> str:
    """Events of three channels, cut into files in arrival order."""
    rng = random.Random(12)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=10 * i), rng.randrange(3), "view", round(rng.uniform(0, 100), 2)) for i in range(300)]
    if shuffle:
        rows = sorted(rows, key=lambda r: r[0] + rng.uniform(-20, 20))  # up to 200 s late
    base = folder()
    per = len(rows) // files
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for k in range(files):
        spark.createDataFrame(rows[k * per : (k + 1) * per], schema).coalesce(1).write.parquet(f"{base}/p{k}")
    return base


def read_live(spark, base):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    raw = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(base)
    return raw.select(
        F.col("user_id").alias("channel"), F.col("event_id").alias("id"), "ts", F.unix_seconds("ts").alias("sclk"),
        F.col("value").alias("pressure"), "event_type",
    )


def test_live_windows_under_late_arrivals_equal_batch(spark):
    """Shuffled arrivals over several micro-batches give what ordered replay gives."""
    base = write_events(spark, 6, True)
    live = run_available(stateful.sliding_features(read_live(spark, base), 20, 5, 50.0, 30.0, delay="10 minutes"))
    got = {(r["channel"], r["window_id"]): (r["end_id"], r["mean"], r["overall_slope"]) for r in live.collect()}
    rows = spark.read.option("recursiveFileLookup", True).parquet(base).collect()
    newest = max(r["ts"] for r in rows) - dt.timedelta(minutes=10)
    checked = 0
    for ch in range(3):
        mine = sorted((r["ts"], r["event_id"], r["value"]) for r in rows if r["user_id"] == ch)
        for k in range((len(mine) - 20) // 5 + 1):
            w = mine[k * 5 : k * 5 + 20]
            if w[-1][0] > newest:
                assert (ch, k) not in got
                continue
            v = np.array([x[2] for x in w])
            end_id, mean, slope = got[(ch, k)]
            assert end_id == w[-1][1] and mean == pytest.approx(v.mean()) and slope == pytest.approx(np.polyfit(range(20), v, 1)[0])
            checked += 1
    assert checked > 30


def test_live_latch_carries_over_batches(spark):
    base = write_events(spark, 5, False)
    s = read_live(spark, base)
    hit = F.col("pressure") >= 70
    det, core = (F.col("id") % 60).between(10, 30), (F.col("id") % 60).between(31, 45)
    got = {r["id"]: r["outcome"] for r in run_available(stateful.latch(s, det, core, hit)).collect()}
    rows = spark.read.option("recursiveFileLookup", True).parquet(base).collect()
    for ch in range(3):
        latched = False
        for r in sorted((r for r in rows if r["user_id"] == ch), key=lambda r: r["event_id"]):
            i, h = r["event_id"], r["value"] >= 70
            if i == 299:  # of the watermark's own millisecond
                assert i not in got
                continue
            d, e = 10 <= i % 60 <= 30, 10 <= i % 60 <= 45
            latched = e and (latched or (d and h))
            assert got[i] == (("TP" if latched else "FN") if e else ("FP" if h else "TN"))


def hot_channel(spark, files: int = 5) -> tuple[str, list]:
    """Readings a few milliseconds apart, nine in ten of one channel, up to 300 ms late, some without value or time."""
    rng = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(microseconds=700 * i), 1 if rng.random() < 0.9 else 2, "view", None if i % 41 == 7 else round(rng.uniform(0, 100), 2)) for i in range(3000)]
    rows = sorted(rows, key=lambda r: r[0] + rng.uniform(-200, 200))
    rows = [*rows[:10], *rows[15:], *rows[10:15]]  # five come at the very end
    rows.insert(50, (9999, None, 1, "view", 1.0))
    base, per = folder(), -(-len(rows) // files)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for k in range(files):
        spark.createDataFrame(rows[k * per : (k + 1) * per], schema).coalesce(1).write.parquet(f"{base}/p{k}")
    return base, rows


def test_hot_channel_equals_batch_and_its_state_is_bounded(spark, monkeypatch):
    """Small slices and list entries: the released order is that of the batch, and no key holds more than its slice."""
    monkeypatch.setattr(stateful, "CHUNK", 64)
    base, rows = hot_channel(spark)
    live = stateful.newest_readings(read_live(spark, base), 20, delay="100 milliseconds", slice_seconds=1)
    for name, value in stateful.STORE.items():
        spark.conf.set(name, value)
    at = folder()
    live.writeStream.format("parquet").option("path", at + "/out").option("checkpointLocation", at + "/state").trigger(availableNow=True).start().awaitTermination()
    got = {(r["channel"], r["id"]): r for r in spark.read.parquet(at + "/out").collect()}
    timed = [r for r in rows if r[1] is not None]
    # A batch drops what lies behind the watermark that the batch before it released by; the others all come, in order.
    per, late, high, kept = -(-len(rows) // 5), None, None, []
    for k in range(5):
        batch = [r for r in rows[k * per : (k + 1) * per] if r[1] is not None]
        kept += [r for r in batch if late is None or r[1] > late]
        late = high
        top = max(r[1] for r in batch) - dt.timedelta(milliseconds=100)
        top = top.replace(microsecond=top.microsecond // 1000 * 1000)
        high = top if high is None else max(high, top)
    assert 0 < len(timed) - len(kept) < 200
    released = 0
    for ch in (1, 2):
        mine = sorted((r for r in kept if r[2] == ch and r[1] < high), key=lambda r: (r[1], r[0]))
        values = [np.nan if r[4] is None else r[4] for r in mine]
        for k, r in enumerate(mine):
            g = got.pop((ch, r[0]))
            assert g["ready"] == (k >= 19)
            w = np.array(values[max(0, k - 19) : k + 1])
            if k >= 19 and not np.isnan(w).any():
                assert g["mean"] == pytest.approx(w.mean())
                released += 1
            else:
                assert g["mean"] is None
    assert not got and released > 1000
    store = lambda name, op: spark.read.format("statestore").option("operatorId", op).option("stateVarName", name).load(at + "/state").collect()
    waiting = {}
    for r in store("waiting", 1):
        entries = [x["us"] for x in r["list_value"]] if "list_value" in r.__fields__ else [r["list_element"]["us"]]
        assert all(len(e) <= 64 for e in entries)
        key = tuple(r["key"])
        waiting[key] = waiting.get(key, 0) + sum(map(len, entries))
    assert sum(waiting.values()) == len([r for r in kept if r[1] >= high])
    assert all(len(r["value"]["carry"]) == 19 for r in store("last", 0))


def test_live_windows_with_a_missing_reading_are_dropped(spark):
    base, rows = hot_channel(spark, 1)
    got = {(r["channel"], r["window_id"]) for r in run_available(stateful.sliding_features(read_live(spark, base), 10, 5, 50.0, 30.0, slice_seconds=1)).collect()}
    newest = max(r[1] for r in rows if r[1] is not None)
    newest = newest.replace(microsecond=newest.microsecond // 1000 * 1000)
    for ch in (1, 2):
        mine = [r[4] for r in sorted((r for r in rows if r[1] is not None and r[2] == ch and r[1] < newest), key=lambda r: (r[1], r[0]))]
        whole = {k for k in range((len(mine) - 10) // 5 + 1) if None not in mine[k * 5 : k * 5 + 10]}
        assert {w for c, w in got if c == ch} == whole


def test_repeats_and_interval_flags(spark):
    base = folder()
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=i // 2), 1, "view", 1.0) for i in range(40)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(base + "/x")
    s = read_live(spark, base)
    assert run_available(continuous.unique_clocks(s)).count() == 20
    start = int(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    centres = spark.createDataFrame([(start + 5,), (start + 6,), (start + 6,)], "sclk long")
    static = continuous.clock_intervals(centres, 2, 1)
    assert max(len(r["spans"]) for r in static.collect()) == 1
    out = run_available(continuous.flag_intervals(s, static)).filter("in_event")
    assert {r["sclk"] - start for r in out.collect()} == {3, 4, 5, 6, 7}


def test_event_stream_reads_the_given_table(spark):
    assert event_stream(spark, "/root/testdata/sf0.001").isStreaming


@pytest.mark.parametrize("name", ["r1_newest_readings", "r3_live_vote", "r4_live_latch"])
def test_replay_releases_the_newest_readings(spark, name):
    """Readings of the newest millisecond and some without a time: all of them count."""
    t0 = dt.datetime(2024, 1, 1)
    kinds = ["view", "click", "error"]
    rows = [(i, t0 + dt.timedelta(microseconds=300 * min(i, 148)), i % 3, kinds[i // 5 % 3], float(i * 37 % 101)) for i in range(150)]
    rows += [(150 + i, None, i % 3, "click", float(i)) for i in range(4)]
    base = folder()
    cols = dict(zip(["event_id", "ts", "user_id", "event_type", "value"], zip(*rows[::-1])))
    pq.write_table(pa.table(cols), f"{base}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{base}/events.parquet'")
    want = con.execute(ORACLES[name]).fetchdf()
    got = QUERIES[name](spark, base).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and canon(got) == canon(want)
    assert (got["n"].sum() if "n" in got else len(got)) == len(rows)


def test_replay_of_files_out_of_order_is_whole(spark):
    """Two buckets for eight channels, one of them null, over batches whose times run backwards."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i), i % 8 or None, "view", float(i * 37 % 101)) for i in range(240)]
    base = folder()
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for k in range(3):
        spark.createDataFrame(rows[160 - 80 * k : 240 - 80 * k], schema).coalesce(1).write.parquet(f"{base}/p{k}")

    def places(s, delay):
        count = lambda seen, carry, ids, vals: {"id": ids, "k": seen + np.arange(len(vals))}
        return stateful.per_channel(s, F.col("pressure"), "id long, k long", count, stateful.tail_of(2), delay, slice_seconds=36_000, buckets=2)

    got = {r["id"]: (r["channel"], r["k"]) for r in run_to_end(read_live(spark, base), places).collect()}
    assert got == {i: (i % 8 or None, i // 8) for i in range(240)}
