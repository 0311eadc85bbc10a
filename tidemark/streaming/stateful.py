"""Position-based operators on live streams.

Row-based windows are not available on streaming frames. Channels are hashed into a fixed number of
buckets, so that calls to the state store and frames handed over are few however many channels there
are. A reading passes three steps, and no task and no state value holds a busy channel's readings:

1. *Buffer*, keyed by bucket and slice of event time. New readings are appended to list state in
   chunks of bounded size; a timer releases them, by channel in event-time order, once the watermark's
   millisecond is past theirs. Late and shuffled arrivals so give the batch result.
2. *Carry*, keyed by bucket. Per released part of a channel it adds what lies before: the number of
   readings seen and the carry (the last ``size - 1`` values, the last votes, an open event). Its state
   is these values; it passes the readings on without working on them.
3. *Step*, stateless and spread again: NumPy over the readings of one part at a time.

Readings without a time are left out (a replay by ``run_to_end`` puts them last). A reading without a value keeps its position: windows that hold
one are dropped, a vote counts it as no hit. Readings of the same microsecond are ordered by id. The
session needs the RocksDB state store (:data:`STORE`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that lists and timers need, as session settings.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Event time of one buffer key, and readings of one list entry.
SLICE_SECONDS, CHUNK = 30 * 86_400, 4096
#: Channel buckets: each costs some state calls a batch, and keeps the carries of its channels in one value.
BUCKETS = 1024
#: Event time of the row that closes a stream (:func:`tidemark.streaming.source.run_to_end`), which is no reading.
CLOSED = dt.datetime(2700, 1, 1, tzinfo=dt.timezone.utc)

#: (readings seen before, carry, ids, values) → output columns
Step = Callable[[int, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]
#: (carry, values) → carry
Fold = Callable[[np.ndarray, np.ndarray], np.ndarray]

_PART = "us array<long>, id array<long>, value array<double>"
_ENTRY = f"channel array<long>, {_PART}"
_COLUMNS = {"channel": "int64", "us": "int64", "id": "int64", "value": "float64"}
_RELEASED = f"bucket int, channel long, {_PART}"
_CARRIED = f"bucket int, channel long, seen long, carry array<double>, {_PART}"


class Buffer(StatefulProcessor):
    """Holds the readings of a bucket's slice until the watermark has passed them."""

    def __init__(self, chunk: int):
        self.chunk = chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ENTRY)
        self.first = handle.getValueState("first", "ms long")

    def _entries(self, cols: list[np.ndarray]) -> list[tuple]:
        return [tuple(c[i : i + self.chunk].tolist() for c in cols) for i in range(0, len(cols[0]), self.chunk)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = None
        for b in rows:
            if not len(b):
                continue
            cols = [b[c].to_numpy(t) for c, t in _COLUMNS.items()]
            for entry in self._entries(cols):
                self.waiting.appendValue(entry)
            low = int(cols[1].min() // 1000)
            least = low if least is None else min(least, low)
        if least is None:
            return
        waits = self.first.get()
        known = waits[0] if waits else None
        mark = timerValues.getCurrentWatermarkInMs()
        if least < mark:
            yield from self._release(key, mark, known)
        elif known is None or least < known:
            self._wait(least, known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if waits := self.first.get():
            known = waits[0]
            mark = timerValues.getCurrentWatermarkInMs()
            if known < mark:
                yield from self._release(key, mark, None)
            else:
                self._wait(known, None)

    def _wait(self, least: int, known: int | None) -> None:
        if known is not None:
            self.handle.deleteTimer(known + 1)
        self.first.update((least,))
        self.handle.registerTimer(least + 1)

    def _release(self, key, mark: int, known: int | None) -> Iterator[pd.DataFrame]:
        entries = list(self.waiting.get())
        cols = [np.concatenate([np.asarray(e[k], t) for e in entries]) for k, t in enumerate(_COLUMNS.values())]
        due = cols[1] // 1000 < mark
        rest = [c[~due] for c in cols]
        channel, us, ids, vals = (c[due] for c in cols)
        if known is not None:
            self.handle.deleteTimer(known + 1)
        if len(rest[0]):
            self.waiting.put(self._entries(rest))
            self._wait(int(rest[1].min() // 1000), None)
        else:
            self.waiting.clear()
            self.first.clear()
        if len(us):
            order = np.lexsort((ids, us, channel))
            channel, us, ids, vals = channel[order], us[order], ids[order], vals[order]
            at = np.flatnonzero(np.diff(channel)) + 1
            yield pd.DataFrame({"bucket": key[0], "channel": channel[np.concatenate([[0], at])], "us": np.split(us, at), "id": np.split(ids, at), "value": np.split(vals, at)})


class Carry(StatefulProcessor):
    """Adds to each released part what its channel's earlier readings leave behind."""

    def __init__(self, fold: Fold):
        self.fold = fold

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Per channel; the carries stand one behind the other.
        self.last = handle.getValueState("last", "channel array<long>, seen array<long>, length array<int>, carry array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [p for b in rows for p in zip(b["channel"], b["us"], b["id"], b["value"])]
        if not parts:
            return
        # Parts of a channel never interleave: slices are apart, and a slice releases once per watermark.
        parts.sort(key=lambda p: (p[0], p[1][0], p[2][0]))
        channels, seen, lengths, carries = self.last.get() or ([], [], [], [])
        ends = np.cumsum(np.asarray(lengths, "int64"))
        last = {c: (n, v) for c, n, v in zip(channels, seen, np.split(np.asarray(carries, "float64"), ends[:-1]))}
        before = []
        for channel, _, _, vals in parts:
            n, carry = last.get(channel, (0, np.empty(0)))
            before.append((n, carry))
            last[channel] = (n + len(vals), self.fold(carry, np.asarray(vals, "float64")))
        channel, us, ids, vals = zip(*parts)
        n, carry = zip(*before)
        yield pd.DataFrame({"bucket": key[0], "channel": channel, "seen": n, "carry": carry, "us": us, "id": ids, "value": vals})
        kept = [v for _, v in last.values()]
        self.last.update(([int(c) for c in last], [int(n) for n, _ in last.values()], [len(v) for v in kept], np.concatenate(kept).tolist()))


def tail_of(reach: int) -> Fold:
    """Carry of the last ``reach`` values."""

    def fold(carry: np.ndarray, vals: np.ndarray) -> np.ndarray:
        both = np.concatenate([carry, vals]) if len(vals) < reach else vals
        return both[max(0, len(both) - reach) :]

    return fold


def per_channel(
    stream: DataFrame, value, schema: str, step: Step, fold: Fold, delay: str = "0 seconds", slice_seconds: int = SLICE_SECONDS, buckets: int = BUCKETS
) -> DataFrame:
    """Run ``step(seen, carry, ids, values)`` on each channel's ordered readings.

    ``value`` is the one number per reading the operator looks at; ``fold`` gives the carry behind a
    part. Output columns are ``channel`` followed by ``schema``. ``slice_seconds`` spreads a channel's
    waiting readings over tasks and bounds what one of them holds; ``buckets`` does so for many channels.
    """
    us = F.unix_micros("ts")
    bucket = F.when(F.col("channel").isNull(), -1).otherwise(F.pmod(F.xxhash64("channel"), F.lit(buckets))).cast("int")
    # The filter looks at the time, so that it stays behind the watermark, which has to see the closing row.
    rows = stream.withWatermark("ts", delay).filter(F.col("ts") < F.lit(CLOSED)).select(
        bucket.alias("bucket"), F.coalesce("channel", F.lit(0)).cast("long").alias("channel"),
        F.floor(us / (slice_seconds * 1_000_000)).cast("long").alias("slice"), "id", "ts", us.alias("us"), value.cast("double").alias("value"),
    )
    parts = rows.groupBy("bucket", "slice").transformWithStateInPandas(Buffer(CHUNK), _RELEASED, "Append", "EventTime")
    carried = parts.groupBy("bucket").transformWithStateInPandas(Carry(fold), _CARRIED, "Append", "None")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for bucket, channel, seen, carry, ids, vals in zip(b["bucket"], b["channel"], b["seen"], b["carry"], b["id"], b["value"]):
                out = step(int(seen), np.asarray(carry, "float64"), np.asarray(ids, "int64"), np.asarray(vals, "float64"))
                if out and (n := len(next(iter(out.values())))):
                    found.append({"bucket": np.full(n, bucket), "channel": np.full(n, channel), **out})
            if found:
                yield pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})

    out = carried.repartition(F.xxhash64("channel", "seen")).mapInPandas(run, f"bucket int, channel long, {schema}")
    return out.withColumn("channel", F.when(F.col("bucket") >= 0, F.col("channel"))).drop("bucket")


def _features(w: np.ndarray, g_mean: float, g_std: float) -> dict[str, np.ndarray]:
    """Training-variant features of stacked windows, one row each."""
    n = w.shape[1]
    half = n // 2

    def slope(y: np.ndarray) -> np.ndarray:
        x = np.arange(y.shape[1]) - (y.shape[1] - 1) / 2
        return (y - y.mean(axis=1, keepdims=True)) @ x / (x @ x)

    low, arg, mean, std = w.min(axis=1), w.argmin(axis=1), w.mean(axis=1), w.std(axis=1)
    s1, s2 = slope(w[:, :half]), slope(w[:, half:])
    m1, m2 = w[:, :half].mean(axis=1), w[:, half:].mean(axis=1)
    drop = w[:, 0] - low
    safe = np.where(std > 0, std, 1.0)
    local = np.where(std > 0, (low - mean) / safe, 0.0)
    return {
        "overall_slope": slope(w),
        "first_half_slope": s1,
        "second_half_slope": s2,
        "trend_consistency": np.abs(s1 - s2),
        "pressure_drop": drop,
        "drop_rate": np.where(arg > 0, drop / np.maximum(arg, 1), 0.0),
        "min_position": arg / (n - 1),
        "mean": mean,
        "std": std,
        "range": w.max(axis=1) - low,
        "first_half_mean": m1,
        "second_half_mean": m2,
        "mean_ratio": np.where(m1 != 0, m2 / np.where(m1 != 0, m1, 1.0), 1.0),
        "min_zscore": (low - g_mean) / g_std if g_std > 0 else local,
        "anomaly_strength": np.abs(local),
    }


FEATURE_NAMES = list(_features(np.zeros((1, 4)), 0.0, 1.0))


def sliding_features(stream: DataFrame, size: int, step: int, g_mean: float, g_std: float, delay: str = "0 seconds", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Count-based sliding windows with features, per channel, as their last reading is released."""

    def cut(seen, carry, ids, vals):
        series = np.concatenate([carry, vals])
        first = seen - len(carry)  # channel position of series[0]
        # Ends among the new readings at positions size-1, size-1+step, …
        pos = np.arange(seen, seen + len(vals))
        ends = pos[(pos >= size - 1) & ((pos - (size - 1)) % step == 0)]
        if not len(ends):
            return {}
        views = np.lib.stride_tricks.sliding_window_view(series, size)[ends - (size - 1) - first]
        whole = ~np.isnan(views).any(axis=1)
        ends, views = ends[whole], views[whole]
        if not len(ends):
            return {}
        return {"window_id": (ends - (size - 1)) // step, "end_id": ids[ends - seen], **_features(views, g_mean, g_std)}

    schema = "window_id long, end_id long, " + ", ".join(f"`{f}` double" for f in FEATURE_NAMES)
    return per_channel(stream, F.col("pressure"), schema, cut, tail_of(size - 1), delay, slice_seconds)


def newest_readings(stream: DataFrame, size: int, delay: str = "0 seconds", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """After every reading: whether the newest ``size`` readings are there, and their mean and slope (null where one has no value)."""

    def latest(seen, carry, ids, vals):
        series = np.concatenate([carry, vals])
        pos = np.arange(seen, seen + len(vals))
        ready = pos >= size - 1
        mean, slope = np.full(len(vals), np.nan), np.full(len(vals), np.nan)
        if ready.any():
            w = np.lib.stride_tricks.sliding_window_view(series, size)[-int(ready.sum()) :]
            x = np.arange(size) - (size - 1) / 2
            mean[ready] = w.mean(axis=1)
            slope[ready] = (w - w.mean(axis=1, keepdims=True)) @ x / (x @ x)
        return {"id": ids, "ready": ready, "mean": mean, "slope": slope}

    out = per_channel(stream, F.col("pressure"), "id long, ready boolean, mean double, slope double", latest, tail_of(size - 1), delay, slice_seconds)
    return out.withColumns({c: F.when(F.col("ready") & ~F.isnan(c), F.col(c)) for c in ("mean", "slope")})


def vote(stream: DataFrame, score, threshold: float, n: int = 3, k: int = 2, delay: str = "0 seconds", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Trailing k-of-n vote per channel."""

    def count(seen, carry, ids, vals):
        hits = (np.concatenate([carry, vals]) >= threshold).astype("float64")
        total = np.convolve(hits, np.ones(n))[len(carry) : len(hits)]
        return {"id": ids, "vote": (total >= k).astype("int32")}

    return per_channel(stream, score, "id long, vote int", count, tail_of(n - 1), delay, slice_seconds)


def _latched(carry: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Event, latched and predicted flags of readings behind a carry (event open, latched)."""
    bits = vals.astype("int64")
    event, trigger, pred = (bits & 3) > 0, (bits & 5) == 5, (bits & 4) > 0
    # Number runs; the first one continues the carried event where there is one.
    was_open, was_latched = (carry[0] > 0, carry[1] > 0) if len(carry) else (False, False)
    breaks = np.cumsum(np.diff(event, prepend=was_open) != 0)
    pulled = np.cumsum(trigger & event)
    base = np.concatenate([[0], pulled[:-1]])
    first_of_run = np.searchsorted(breaks, breaks, side="left")
    latched = (pulled - base[first_of_run]) > 0
    latched |= (breaks == 0) & was_open & was_latched
    return event, latched, pred


def latch(stream: DataFrame, precursor, core, hit, delay: str = "0 seconds", slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Point outcomes where a hit in the precursor latches until its event closes: TP, FN, FP, TN. A null flag counts as false."""

    def walk(seen, carry, ids, vals):
        event, latched, pred = _latched(carry, vals)
        outcome = np.where(event, np.where(latched, "TP", "FN"), np.where(pred, "FP", "TN"))
        return {"id": ids, "outcome": outcome.astype(object)}

    def last(carry, vals):
        event, latched, _ = _latched(carry, vals)
        return np.array([float(event[-1]), float(event[-1] and latched[-1])])

    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return per_channel(stream, flag(precursor) + flag(core) * 2 + flag(hit) * 4, "id long, outcome string", walk, last, delay, slice_seconds)
