"""X3 and T10 live: the spend gate with manual overrides over rows that arrive out of order.

Whether a message is served depends on all messages and overrides of its day
that come before it in event time, so a row is decided only when its
predecessors are known: when the frontier (the largest event time seen less the
allowed ``delay``) has passed it. Until then it waits in the buffer. Each
micro-batch takes the rows behind the new frontier, decides them with the batch
operator :func:`~msgscreen.operators.traffic.apply_overrides` on top of the
state of the day (what it has cost, when it crossed the limit, its last
override), and commits decisions, state, buffer and frontier together. Rows
that arrive behind the frontier are late: they go to ``late`` and change nothing.

Results equal the batch gate's for any delivery within ``delay``. Prefix sums
are two-level as in the batch gate, so no day is one task. State holds the days
from the day before the frontier on; buffers and states of earlier batches are
removed once a batch has committed. A repeated batch starts from its
predecessor's committed state and overwrites its own parts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dictionaries as D
from ..operators import traffic as TR
from .parts import Parts, start

ROWS = f"event_id long, ts timestamp, date date, cost {TR.MONEY}, action string"
DECIDED = f"event_id long, ts timestamp, date date, cost {TR.MONEY}, override string, accepted boolean, alert boolean, spend_before {TR.MONEY}"


def gate_rows(messages: DataFrame, cost: str = D.COST_PER_MESSAGE) -> DataFrame:
    """Messages (event_id, ts, with or without a cost) as rows of the gate."""
    c = F.col("cost") if "cost" in messages.columns else F.lit(cost)
    return messages.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("date"), c.cast(TR.MONEY).alias("cost"), F.lit(None).cast("string").alias("action"))


def override_rows(overrides: DataFrame) -> DataFrame:
    """Overrides (event_id, ts, action enable/disable) as rows of the gate."""
    return overrides.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("date"), F.lit(None).cast(TR.MONEY).alias("cost"), "action")


def _decide(parts: Parts, ready: DataFrame, state: DataFrame, limit: str, n: int) -> DataFrame:
    """Write the decisions of the rows that are ready; the state after them."""
    overrides = ready.where("action IS NOT NULL")
    gated = TR.apply_overrides(ready.where("action IS NULL").drop("action"), overrides.drop("cost"), limit=limit, state=state)
    decided = parts.write(gated.select("event_id", "ts", "date", "cost", "override", "accepted", "alert", "spend_before"), "gate", n)
    return TR.gate_state(decided, overrides, state)


def _now(text: str | None) -> dt.datetime:
    return dt.datetime.fromisoformat(text) if text else dt.datetime(1, 1, 1)


def start_ordered_gate(rows: DataFrame, path: str, checkpoint: str, limit: str = D.DAILY_SPEND_LIMIT, delay: dt.timedelta = dt.timedelta(minutes=10),
                       available_now: bool = True):
    """Decide a stream of :func:`gate_rows` and :func:`override_rows`; results under ``path`` (:func:`read_gate`)."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        parts = Parts(spark, path)
        if parts.committed(n):
            return
        before = parts.last(n)
        frontier = _now(parts.record(before)["frontier"] if before is not None else None)
        earlier = [] if before is None else [before]
        state = parts.read("state", TR.STATE, earlier).drop("batch")
        waiting = parts.read("buffer", ROWS, earlier).drop("batch")
        mark = F.lit(frontier.isoformat(sep=" ")).cast("timestamp")
        parts.write(batch.select(*waiting.columns).where(F.col("ts") < mark), "late", n)
        taken = parts.write(batch.select(*waiting.columns).where(F.col("ts") >= mark).unionByName(waiting), "taken", n)
        newest = taken.agg(F.max("ts").cast("string").alias("ts")).first().ts
        frontier = max(frontier, dt.datetime.fromisoformat(newest) - delay) if newest else frontier
        mark = F.lit(frontier.isoformat(sep=" ")).cast("timestamp")
        after = _decide(parts, taken.where(F.col("ts") < mark), state, limit, n)
        parts.write(after.where(F.col("date") >= F.date_sub(mark.cast("date"), 1)), "state", n)
        parts.write(taken.where(F.col("ts") >= mark), "buffer", n)
        parts.commit(n, frontier=frontier.isoformat())
        for name in ("state", "buffer", "taken"):
            parts.drop(name, n - 1)

    return start(rows, step, checkpoint, available_now=available_now)


def close_gate(spark: SparkSession, path: str, limit: str = D.DAILY_SPEND_LIMIT) -> None:
    """Decide what still waits, at the end of a feed; the stream must not be running."""
    parts = Parts(spark, path)
    last = parts.last()
    if last is None:
        return
    after = _decide(parts, parts.read("buffer", ROWS, [last]).drop("batch"), parts.read("state", TR.STATE, [last]).drop("batch"), limit, last + 1)
    parts.write(after, "state", last + 1)
    parts.write(spark.createDataFrame([], ROWS), "buffer", last + 1)
    parts.commit(last + 1, frontier=dt.datetime(9999, 1, 1).isoformat())


def read_gate(spark: SparkSession, path: str) -> DataFrame:
    return Parts(spark, path).read("gate", DECIDED).drop("batch")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    return Parts(spark, path).read("late", ROWS).drop("batch")
