"""Event stream source and the run-to-completion helper used for replays and tests."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import scratch_root
from tidemark.sources.adapters import epoch_seconds
from tidemark.streaming.stateful import CLOSED, STORE

#: Event time that stands in for a missing one in a whole replay: behind all others.
UNTIMED = dt.datetime(2261, 12, 31, tzinfo=dt.timezone.utc)
#: Watermark delay of a whole replay, in which no reading is late; the closing row still passes all times.
WHOLE = "146100 days"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", batch_bytes: int = 1 << 30) -> DataFrame:
    """Event log as a live stream: channel, id, event time, clock in seconds, pressure, kind.

    ``batch_bytes`` bounds what one micro-batch reads, and so what one busy channel can bring at once.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxBytesPerTrigger", batch_bytes).parquet(folder)
    seconds = epoch_seconds(raw, "ts")
    if isinstance(schema["ts"].dataType, T.TimestampNTZType):
        micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    else:
        micros = F.unix_micros("ts")
    return raw.select(
        F.col("user_id").alias("channel"), F.col("event_id").alias("id"), F.timestamp_micros(micros).alias("ts"),
        seconds.cast("long").alias("sclk"), F.col("value").alias("pressure"), "event_type",
    )


def _run(df: DataFrame, base: str, mode: str) -> None:
    spark = df.sparkSession
    for name, value in STORE.items():
        spark.conf.set(name, value)
    query = (
        df.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_available(df: DataFrame, mode: str = "append") -> DataFrame:
    """Process what is there now, write it to a Parquet table with a checkpoint, return the table."""
    spark = df.sparkSession
    base = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    _run(df, base, mode)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_to_end(stream: DataFrame, build: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Replay the whole of ``stream`` through ``build(stream, delay)``, which ends in a position-based operator.

    A watermark alone never passes the newest readings. So when all that is there has been taken in, a
    closing row is added from a folder of its own, and the query goes on until it has released
    everything. Files may come in any order; readings without a time come last, by id.
    """
    spark = stream.sparkSession
    base = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    closing = spark.createDataFrame([], stream.schema)
    closing.write.parquet(f"{base}/closing")
    timed = stream.withColumn("ts", F.coalesce("ts", F.lit(UNTIMED)))
    live = build(timed.unionByName(spark.readStream.schema(stream.schema).parquet(f"{base}/closing")), WHOLE)
    _run(live, base, "append")
    last = spark.range(1).select(*[F.lit(CLOSED if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in stream.schema])
    last.write.mode("append").parquet(f"{base}/closing")
    _run(live, base, "append")
    return spark.read.schema(live.schema).parquet(f"{base}/out")
