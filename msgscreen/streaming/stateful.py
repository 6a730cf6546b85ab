"""X7 and X8 live: the sender rate limit, sender sessions and volume spikes.

The rate limit keeps its state per time bucket *and* shard of senders (by hash):
most senders send little, and a state, a timer and calls of their own for each
sender and bucket would cost far more than counting. As in the batch form a row
is placed in its own bucket and, as context, in the next, so a bucket's state
holds every row its own rows have to count, a sender's traffic is spread over
tasks by time, and state goes when its bucket is over. Rows are kept as they
came, in Arrow chunks. A bucket is answered when the watermark has passed its
end: late rows within the watermark are counted like all others, and the answers
equal the batch form's. State is kept in RocksDB, outside the heap.

Sessions are Spark's session windows: rows that arrive late merge the sessions
they connect, and sessions of one task are merged before the shuffle, so a hot
sender sends few of them. Spikes go on from a table of the hours' counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import dictionaries as D
from ..operators import traffic as TR
from .parts import Parts, start

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The id is text on its way: a null among longs would turn a whole Arrow batch's column into floats.
RATE_OUT = "event_id string, sender string, ts timestamp, recent long, throttled boolean"
STREAM_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
               "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


@contextmanager
def stream_settings(spark: SparkSession):
    """The settings these streams start with; a started stream keeps them, the session gets its own back."""
    old = {k: spark.conf.get(k, None) for k in STREAM_CONF}
    for k, v in STREAM_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Parts that a time bucket's senders are dealt to; part of the state's key, so a checkpoint goes on with its own number only.
RATE_SHARDS = 64
CHUNK = pa.schema([("us", pa.int64()), ("event_id", pa.string()), ("sender", pa.string()), ("own", pa.bool_())])


class RateWindow(StatefulProcessor):
    """Rows of one shard of senders and time bucket; answers its own ones when the bucket is over."""

    def __init__(self, limit: int, seconds: int):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            batch = pa.RecordBatch.from_pandas(frame[CHUNK.names], CHUNK, preserve_index=False)
            self.chunks.appendValue((batch.serialize().to_pybytes(),))
        self.handle.registerTimer((int(key[1]) + 1) * self.seconds * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(c[0]), CHUNK) for c in self.chunks.get()], CHUNK).to_pandas()
        self.chunks.clear()
        own = rows["own"].to_numpy(dtype=bool)
        if own.any():
            width = self.seconds * 1_000_000
            us, sender = rows["us"].to_numpy(), pd.factorize(rows["sender"], use_na_sentinel=False)[0].astype(np.int64)
            # one line for all senders, so far apart that nobody's window reaches another's rows (a state spans two buckets)
            at = sender * (3 * width + 1) + (us - (int(key[1]) - 1) * width)
            line, mine = np.sort(at), at[own]
            recent = np.searchsorted(line, mine, "right") - np.searchsorted(line, mine - width, "left")
            yield pd.DataFrame({"event_id": rows["event_id"].to_numpy()[own], "sender": rows["sender"].to_numpy()[own], "ts": pd.to_datetime(us[own], unit="us"),
                                "recent": recent, "throttled": recent > self.limit})

    def close(self) -> None:
        pass


def sender_rate_stream(stream: DataFrame, limit: int = D.SENDER_RATE_LIMIT, seconds: int = D.SENDER_RATE_WINDOW_S, watermark: str = "10 minutes") -> DataFrame:
    """X7 live: (event_id, sender, ts, recent, throttled); start it within :func:`stream_settings`."""
    s = stream.withWatermark("ts", watermark).select(F.col("event_id").cast("string").alias("event_id"), "sender", "ts", F.unix_micros("ts").alias("us"))
    bucket = F.floor(F.col("us") / F.lit(seconds * 1_000_000)).cast("long")
    s = s.withColumn("place", F.explode(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("own")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("own")))))
    s = s.withColumn("shard", F.pmod(F.xxhash64("sender"), F.lit(RATE_SHARDS)).cast("int"))
    return (s.select("event_id", "sender", "ts", "us", "shard", "place.bucket", "place.own").groupBy("shard", "bucket")
            .transformWithStateInPandas(RateWindow(limit, seconds), RATE_OUT, "append", "EventTime")
            .withColumn("event_id", F.col("event_id").cast(stream.schema["event_id"].dataType)))


def sender_sessions_stream(stream: DataFrame, gap_seconds: int = 1800, min_messages: int = 20, watermark: str = "1 hour") -> DataFrame:
    """X8 live: a row per session when the watermark has passed its end; rows without a sender have no session. Start it within :func:`stream_settings`."""
    # sessions that touch are one: a silence of exactly the gap does not end a session
    window = F.session_window("ts", f"{gap_seconds} seconds")
    # rows without a sender go only here, where they have moved the watermark: a filter on the key would be pushed below it
    return (stream.withWatermark("ts", watermark).groupBy("sender", window.alias("w"))
            .agg(F.count(F.lit(1)).alias("messages"), F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count("sender").alias("_named"))
            .where("_named > 0")
            .select("sender", "messages", "session_start", "session_end", (F.col("messages") > min_messages).alias("unusual")))


HOURS = "hour long, requests long, errors long"
SPIKES = "bucket_start timestamp, requests long, errors long, trailing_mean double, error_rate double, spike boolean, high_errors boolean"


def start_volume_spikes(stream: DataFrame, path: str, checkpoint: str, trailing: int = 24, factor: float = 3.0, watermark: str = "1 hour", available_now: bool = True):
    """X8 live: each hour is judged once, when the watermark has passed it, against the hours before it.

    Hours come out in ascending order. The table of counts that the next batch
    goes on from holds the last ``trailing`` hours."""
    hours = (stream.withWatermark("ts", watermark).groupBy(F.window("ts", "1 hour").alias("w"))
             .agg(F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"))
             .select((F.unix_seconds("w.start") / 3600).cast("long").alias("hour"), "requests", "errors"))

    def step(batch: DataFrame, n: int) -> None:
        parts = Parts(batch.sparkSession, path)
        if parts.committed(n):
            return
        before = parts.last(n)
        first = parts.record(before)["first"] if before is not None else None
        new = parts.write(batch, "new", n)
        span = new.agg(F.min("hour").alias("low"), F.max("hour").alias("high")).first()
        first = first if first is not None else span.low
        held = parts.read("hours", HOURS, [] if before is None else [before]).drop("batch")
        known = held.unionByName(new)
        judged = TR.hourly_spikes(known, trailing, factor, first) if first is not None else TR.hourly_spikes(known, trailing, factor)
        if span.low is not None:
            judged = judged.where(F.unix_seconds("bucket_start") >= span.low * 3600)
        else:
            judged = judged.where("false")
        parts.write(judged.select("bucket_start", "requests", "errors", "trailing_mean", "error_rate", "spike", "high_errors"), "spikes", n)
        parts.write(known.where(F.col("hour") > span.high - trailing) if span.high is not None else known, "hours", n)
        parts.commit(n, first=first)
        parts.drop("hours", n - 1)
        parts.drop("new", n - 1)

    return start(hours, step, checkpoint, available_now=available_now)


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    return Parts(spark, path).read("spikes", SPIKES).drop("batch")
