"""Traffic, spend and budget analytics (T1–T13) and the batch forms of the
documented stream/monitoring jobs (X4, X6–X8).

Skew: one day (or one sender) may hold a third of all rows, so no job sorts a
whole day in one task. Running sums and as-of lookups are two-level: totals
per (key, minute bucket) form a small table (<= 1,440 rows per day) whose
prefix sums are joined back, and only one bucket's rows are ordered
together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D

MONEY = "decimal(12,4)"


def privacy_projection(scored: DataFrame, salt: str) -> DataFrame:
    """The history record — no text, no number; length and a salted
    SHA-256 of the sender (stable across processes, unlike a runtime hash).
    Numbers can be found by trying them all under a known salt, so the
    caller must supply a secret one."""
    return scored.select(
        "event_id", F.col("ts").alias("timestamp"), F.to_date("ts").alias("date"),
        F.col("label").alias("classification"), "is_smishing", "confidence", "via_sms",
        F.length("text").cast("long").alias("message_length"),
        F.when(F.col("sender").isNotNull(), F.sha2(F.concat(F.lit(salt), F.col("sender")), 256))
         .alias("from_number_hash"))


def daily_counters(history: DataFrame) -> DataFrame:
    """T2 + T3: per date total / spam / smishing / ham / SMS counts and rates.
    Spam = label spam or smishing, or the smishing flag; smishing rate is
    smishing / spam; rates are 0 when the denominator is 0."""
    spam = F.col("classification").isin("spam", "smishing") | F.col("is_smishing")
    g = history.groupBy("date").agg(
        F.count(F.lit(1)).alias("total_messages"),
        F.count_if(spam).alias("spam_count"),
        F.count_if(spam & F.col("is_smishing")).alias("smishing_count"),
        F.count_if(~spam).alias("ham_count"),
        F.count_if(F.col("via_sms")).alias("sms_received"))
    return (g.withColumn("spam_rate", F.coalesce(F.try_divide(F.col("spam_count").cast("double"),
                                                              F.col("total_messages")), F.lit(0.0)))
             .withColumn("smishing_rate", F.coalesce(F.try_divide(F.col("smishing_count").cast("double"),
                                                                  F.col("spam_count")), F.lit(0.0))))


def last_days(counters: DataFrame, days: int = 7) -> DataFrame:
    """T4: the ``days`` newest days (top-N by date; TakeOrderedAndProject)."""
    return counters.orderBy(F.desc("date")).limit(days)


def last_messages(history: DataFrame, n: int = 100) -> DataFrame:
    """T5: the ``n`` newest history records (ties by event id)."""
    return history.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(n)


def _bucket(ts, seconds: int):
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def running_sum(df: DataFrame, value: str, key: str, ts: str, tie: str, bucket_seconds: int) -> DataFrame:
    """Add ``_before``: the sum of ``value`` over the key's earlier rows in
    (ts, tie) order = earlier buckets' totals (a table of at most
    86400 / bucket_seconds rows per day) + the running sum inside the bucket."""
    t = df.withColumn("_b", _bucket(F.col(ts), bucket_seconds))
    totals = t.groupBy(key, "_b").agg(F.sum(value).alias("_bsum"))
    w_prev = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = totals.select(key, "_b", F.coalesce(F.sum("_bsum").over(w_prev), F.lit(0)).cast(MONEY).alias("_off"))
    w_in = Window.partitionBy(key, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, -1)
    before = (F.col("_off") + F.coalesce(F.sum(value).over(w_in), F.lit(0))).cast(MONEY)
    return t.join(offs, [key, "_b"]).withColumn("_before", before).drop("_b", "_off")


def accept(traffic: DataFrame, cost: str = D.COST_PER_MESSAGE, limit: str = D.DAILY_SPEND_LIMIT,
           key: str = "date", ts: str = "ts", tie: str = "event_id", bucket_seconds: int = 60) -> DataFrame:
    """T7 + T8: add ``accepted`` (the day's spend *before* the message is below
    the limit) and ``alert`` (its cost reaches the limit). Costs >= 0, so the
    accepted rows of a day are a prefix."""
    c = F.lit(cost).cast(MONEY) if "cost" not in traffic.columns else F.col("cost").cast(MONEY)
    lim = F.lit(limit).cast(MONEY)
    out = running_sum(traffic.withColumn("cost", c), "cost", key, ts, tie, bucket_seconds)
    out = out.withColumn("accepted", F.col("_before") < lim)
    return (out.withColumn("alert", F.col("accepted") & (F.col("_before") + F.col("cost") >= lim))
               .withColumnRenamed("_before", "asked_before"))


def spend_gate(traffic: DataFrame, key: str = "date", **options) -> DataFrame:
    """:func:`accept` and ``spend_before``, the day's spend before the message;
    refused messages add nothing to it."""
    out = accept(traffic, key=key, **options)
    # the spend at which a day closed: one row per day
    closed = out.filter("alert").groupBy(key).agg(F.max(F.col("asked_before") + F.col("cost")).alias("_closed"))
    return (out.join(closed, key, "left")
               .withColumn("spend_before", F.least("asked_before", F.coalesce("_closed", "asked_before")).cast(MONEY))
               .drop("asked_before", "_closed"))


def spend_ledger(gated: DataFrame, key: str = "date") -> DataFrame:
    """Per day the charged spend and message count (accepted messages
    are charged, errors included; rejected ones are not)."""
    return gated.filter("accepted").groupBy(key).agg(
        F.sum("cost").alias("daily_spend"), F.count(F.lit(1)).alias("message_count"))


def budget_status(ledger: DataFrame, limit: str = D.DAILY_SPEND_LIMIT) -> DataFrame:
    """Enabled, spend, remaining = max(0, limit - spend) and the band
    (>= 90 % critical, >= 70 % warning, else normal)."""
    lim = F.lit(limit).cast(MONEY)
    share = F.col("daily_spend") / lim
    return ledger.select(
        "date", "daily_spend", "message_count",
        (F.col("daily_spend") < lim).alias("enabled"),
        F.greatest(F.lit(0).cast(MONEY), lim - F.col("daily_spend")).alias("remaining_budget"),
        F.when(share >= D.BUDGET_CRITICAL_SHARE, F.lit("critical"))
         .when(share >= D.BUDGET_WARNING_SHARE, F.lit("warning")).otherwise(F.lit("normal")).alias("band"))


def last_override(messages: DataFrame, overrides: DataFrame, key: str = "date", ts: str = "ts",
                  tie: str = "event_id", bucket_seconds: int = 60) -> DataFrame:
    """As-of join: add ``override`` and ``override_ts``, the last override
    (``action`` enable/disable) of the day at or before each message (at the
    same instant the override comes first; of two, that of the larger id).

    Two-level, skew-safe: (1) the last override per (day, bucket) and the
    message buckets form a small table (<= 2 x buckets per day) on which
    ``last(ignorenulls)`` carries the latest override of any *earlier* bucket;
    (2) inside a bucket, overrides and messages are ordered together."""
    o = (overrides.select(key, F.col(ts), F.col(tie).alias("_id"), F.struct(F.col(ts).alias("at"), F.col("action")).alias("_o"))
         .withColumn("_b", _bucket(F.col(ts), bucket_seconds)))
    m = messages.withColumn("_b", _bucket(F.col(ts), bucket_seconds))
    none = F.lit(None).cast(o.schema["_o"].dataType)
    ob = o.groupBy(key, "_b").agg(F.max_by("_o", F.struct(ts, "_id")).alias("_last")).withColumn("_k", F.lit(0))
    mb = m.select(key, "_b").distinct().withColumn("_last", none).withColumn("_k", F.lit(1))
    w_prev = Window.partitionBy(key).orderBy(F.col("_b"), F.col("_k").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    prev = (ob.unionByName(mb).withColumn("_prev", F.last("_last", ignorenulls=True).over(w_prev))
            .filter(F.col("_k") == 1).select(key, "_b", "_prev"))
    u = (m.withColumn("_o", none).withColumn("_id", F.col(tie)).withColumn("_kind", F.lit(1))
         .unionByName(o.withColumn("_kind", F.lit(0)), allowMissingColumns=True))
    w_in = Window.partitionBy(key, "_b").orderBy(ts, "_kind", "_id").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("_inb", F.last("_o", ignorenulls=True).over(w_in))
    res = u.filter(F.col("_kind") == 1).join(prev, [key, "_b"], "left").withColumn("_act", F.coalesce("_inb", "_prev"))
    return (res.withColumn("override", F.col("_act.action")).withColumn("override_ts", F.col("_act.at"))
               .drop("_b", "_kind", "_o", "_id", "_inb", "_prev", "_act"))


def apply_overrides(traffic: DataFrame, overrides: DataFrame, cost: str = D.COST_PER_MESSAGE,
                    limit: str = D.DAILY_SPEND_LIMIT, key: str = "date", ts: str = "ts", tie: str = "event_id",
                    bucket_seconds: int = 60, state: DataFrame | None = None) -> DataFrame:
    """The gate with manual overrides. The service's state is the last of
    {override, crossing}: the first accepted message whose cost brings the
    day's spend to the limit closes the service once a day; before it the last
    override decides (open without one), after it only an override later than
    the crossing does. Refused messages cost nothing; messages accepted after
    a re-enable are charged again."""
    c = F.lit(cost).cast(MONEY) if "cost" not in traffic.columns else F.col("cost").cast(MONEY)
    lim, zero = F.lit(limit).cast(MONEY), F.lit(0).cast(MONEY)
    t = last_override(traffic.withColumn("cost", c), overrides, key, ts, tie, bucket_seconds)
    spent, crossed_before = zero, F.lit(None).cast("timestamp")
    if state is not None:
        t = t.join(F.broadcast(state.select(key, F.col("spent").alias("_spent"), F.col("crossed").alias("_was"), F.struct("action", "at").alias("_act"))), key, "left")
        t = t.withColumns({"override": F.coalesce("override", "_act.action"), "override_ts": F.coalesce("override_ts", "_act.at")})
        spent, crossed_before = F.coalesce("_spent", zero), F.col("_was")
    is_open = F.coalesce(F.col("override") == "enable", F.lit(True))
    t = t.withColumn("_open", is_open).withColumn("_paid", F.when(F.col("_open"), F.col("cost")).otherwise(zero))
    t = running_sum(t, "_paid", key, ts, tie, bucket_seconds).withColumn("_before", (F.col("_before") + spent).cast(MONEY))
    crossing = F.col("_open") & (F.col("_before") < lim) & (F.col("_before") + F.col("_paid") >= lim)
    t = t.withColumn("alert", crossing)
    crossed = t.filter("alert").groupBy(key).agg(F.min(ts).alias("_crossed"))        # one row per day
    t = t.join(crossed, key, "left").withColumn("_crossed", F.coalesce("_crossed", crossed_before))
    reopened = F.coalesce((F.col("override") == "enable") & (F.col("override_ts") > F.col("_crossed")), F.lit(False))
    t = t.withColumn("accepted", F.when(F.col("_before") < lim, F.col("_open")).otherwise(reopened))
    t = t.withColumn("_paid", F.when(F.col("accepted"), F.col("cost")).otherwise(zero)).drop("_before")
    return (running_sum(t, "_paid", key, ts, tie, bucket_seconds)
            .withColumn("spend_before", (F.col("_before") + spent).cast(MONEY)).withColumn("service_enabled", F.col("accepted"))
            .drop("_before", "_paid", "_open", "_crossed", "override_ts", "_spent", "_was", "_act"))


STATE = f"date date, spent {MONEY}, crossed timestamp, action string, at timestamp"


def gate_state(gated: DataFrame, overrides: DataFrame, before: DataFrame, key: str = "date", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The state after ``gated`` (of :func:`apply_overrides`) and ``overrides``, from the state before: what each day
    has cost, when it crossed the limit, and its last override."""
    last = overrides.groupBy(key).agg(F.max_by(F.struct("action", F.col(ts).alias("at")), F.struct(ts, tie)).alias("o"))
    none = F.lit(None).cast("timestamp")
    parts = (before.select(key, "spent", "crossed", "action", "at")
             .unionByName(gated.select(key, F.when(F.col("accepted"), F.col("cost")).otherwise(0).cast(MONEY).alias("spent"), F.when(F.col("alert"), F.col(ts)).alias("crossed"),
                                       F.lit(None).cast("string").alias("action"), none.alias("at")))
             .unionByName(last.select(key, F.lit(0).cast(MONEY).alias("spent"), none.alias("crossed"), "o.action", "o.at")))
    # a later batch's override is the later one: its instants lie behind the frontier of the batch before
    return parts.groupBy(key).agg(F.sum("spent").cast(MONEY).alias("spent"), F.min("crossed").alias("crossed"),
                                  F.max_by("action", "at").alias("action"), F.max("at").alias("at"))


def reconcile(ledger: DataFrame, provider: DataFrame) -> DataFrame:
    """Provider count and sum(|price|) per day (null prices skipped),
    full outer join with our ledger, and the differences."""
    p = provider.groupBy(F.to_date("date_sent").alias("date")).agg(
        F.count(F.lit(1)).alias("provider_count"),
        F.sum(F.abs(F.col("price").cast(MONEY))).alias("provider_cost"))
    j = ledger.join(p, "date", "full_outer")
    return j.select("date", "daily_spend", "message_count", "provider_count", "provider_cost",
                    (F.coalesce("provider_cost", F.lit(0).cast(MONEY))
                     - F.coalesce("daily_spend", F.lit(0).cast(MONEY))).alias("cost_delta"),
                    (F.coalesce("provider_count", F.lit(0)) - F.coalesce("message_count", F.lit(0))).alias("count_delta"))


def dashboard_series(history: DataFrame, bucket: str = "1 hour", samples: int = 10) -> DataFrame:
    """Counts per time bucket and the last ``samples`` buckets (real
    smishing counts, not a share of spam)."""
    spam = F.col("classification").isin("spam", "smishing") | F.col("is_smishing")
    g = history.groupBy(F.window("timestamp", bucket).alias("w")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(spam).alias("spam"),
        F.count_if(spam & F.col("is_smishing")).alias("smishing"), F.count_if(~spam).alias("ham"))
    w = Window.orderBy(F.desc("bucket_start"))
    return (g.select(F.col("w.start").alias("bucket_start"), "total", "spam", "smishing", "ham")
             .withColumn("sample", F.row_number().over(w)).filter(F.col("sample") <= samples))


def cost_projection(ledger: DataFrame, number_cost: str = D.MONTHLY_NUMBER_COST,
                    cost: str = D.COST_PER_MESSAGE) -> DataFrame:
    """Monthly cost = number rental + per-message cost x messages."""
    g = ledger.groupBy(F.date_trunc("month", F.col("date")).cast("date").alias("month")).agg(
        F.sum("message_count").alias("messages"))
    return g.withColumn("projected_cost", (F.lit(number_cost).cast(MONEY)
                                           + F.lit(cost).cast(MONEY) * F.col("messages")).cast(MONEY))


def global_rank(df: DataFrame, ts: str, tie: str, bucket_seconds: int = 60) -> DataFrame:
    """Add ``_rn``: 1-based position in the global (ts, tie) order, without a
    single-partition window: per-bucket counts (bounded by the time range)
    give offsets, and only one bucket's rows are sorted together."""
    t = df.withColumn("_gb", _bucket(F.col(ts), bucket_seconds))
    counts = t.groupBy("_gb").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_gb").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_gb", F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off"))
    j = t.join(offs, "_gb")
    rn = F.col("_off") + F.row_number().over(Window.partitionBy("_gb").orderBy(ts, tie))
    return j.withColumn("_rn", rn).drop("_gb", "_off")


def feedback_triggers(feedback: DataFrame, every: int = D.FEEDBACK_RETRAIN_EVERY, ts: str = "timestamp",
                      tie: str = "feedback_id") -> DataFrame:
    """X4 (batch form): every ``every``-th correction (in time order) triggers
    a retrain and clears the buffer; one row per trigger with the batch
    number, the first correction time and the trigger time."""
    r = global_rank(feedback, ts, tie).withColumn("batch", F.floor((F.col("_rn") - 1) / every).cast("long"))
    g = r.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return g.filter(F.col("n") == every).select("batch", "first_ts", F.col("last_ts").alias("trigger_ts"))


def traffic_metrics(traffic: DataFrame, width: str = "1 minute", slide: str | None = None) -> DataFrame:
    """X6 (batch form): per window — requests, rate per second, error rate,
    latency p50/p95/p99 (exact), and the prediction mix."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = traffic.groupBy(win.alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("is_error")).alias("errors"),
        F.percentile("latency_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("_p"),
        F.count_if(F.col("label") == "ham").alias("ham"),
        F.count_if(F.col("label") == "spam").alias("spam"),
        F.count_if(F.col("label") == "smishing").alias("smishing"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests",
                    (F.col("requests") / (F.unix_micros(F.col("w.end").cast("timestamp"))
                                          - F.unix_micros(F.col("w.start").cast("timestamp"))) * 1e6).alias("rate_per_s"),
                    (F.col("errors") / F.col("requests")).alias("error_rate"),
                    F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p95"), F.col("_p")[2].alias("p99"),
                    "ham", "spam", "smishing")


def sender_rate_limit(traffic: DataFrame, limit: int = D.SENDER_RATE_LIMIT, seconds: int = D.SENDER_RATE_WINDOW_S,
                      key: str = "sender", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """X7 (batch form): messages of the same sender in the last ``seconds``
    (inclusive) at each message; over ``limit`` -> throttled.

    Skew-safe exact range count: each row is placed in its own time bucket
    (width = ``seconds``) and copied as context into the next bucket, so a
    window partitioned by (sender, bucket) sees every row it can need and
    never more than two buckets of one sender."""
    b = _bucket(F.col(ts), seconds)
    base = traffic.select(key, ts, tie).withColumn("_b", b)
    own = base.withColumn("_own", F.lit(True))
    ctx = base.withColumn("_b", F.col("_b") + 1).withColumn("_own", F.lit(False))
    u = own.unionByName(ctx)
    t = F.unix_micros(F.col(ts))
    w = (Window.partitionBy(key, "_b").orderBy(t)
         .rangeBetween(-seconds * 1_000_000, 0))
    c = u.withColumn("recent", F.count(F.lit(1)).over(w))
    # rows with equal ts after this row are inside the frame too (range frame), as in the batch definition
    return (c.filter("_own").drop("_b", "_own")
             .withColumn("throttled", F.col("recent") > limit))


def volume_spikes(traffic: DataFrame, trailing: int = 24, factor: float = 3.0) -> DataFrame:
    """X8 (batch form): request and error counts per hour against the mean of
    the previous ``trailing`` hours (hours without requests count as 0, hours
    before the first request don't count); spike when count > factor x mean.
    The window runs over the hours' small table."""
    return hourly_spikes(hourly_counts(traffic), trailing, factor)


def hourly_counts(traffic: DataFrame) -> DataFrame:
    """(hour, requests, errors): hours since the epoch."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    return traffic.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("is_error")).alias("errors"))


def hourly_spikes(hours: DataFrame, trailing: int = 24, factor: float = 3.0, first_hour: int | None = None) -> DataFrame:
    """:func:`volume_spikes` from the hours' counts; ``first_hour`` where these don't reach back to the first request."""
    w = Window.orderBy("hour").rangeBetween(-trailing, -1)
    first = F.min("hour").over(Window.partitionBy()) if first_hour is None else F.lit(first_hour).cast("long")
    past = F.least(F.lit(trailing), F.col("hour") - first)
    mean = F.when(past > 0, F.coalesce(F.sum("requests").over(w), F.lit(0)) / past)
    return (hours.withColumn("trailing_mean", mean)
             .withColumn("error_rate", F.col("errors") / F.col("requests"))
             .withColumn("spike", F.col("requests") > F.col("trailing_mean") * factor)
             .withColumn("high_errors", F.col("error_rate") > D.ERROR_RATE_ALERT)
             .withColumn("bucket_start", F.timestamp_seconds(F.col("hour") * 3600)).drop("hour"))


def sender_sessions(traffic: DataFrame, gap_seconds: int = 1800, key: str = "sender", ts: str = "ts",
                    tie: str = "event_id", bucket_seconds: int = 3600, min_messages: int = 20) -> DataFrame:
    """X8 (batch form): per-sender sessions (a new session after more than
    ``gap_seconds`` of silence) with message count, start, end and an
    ``unusual`` flag (more than ``min_messages`` in one session). Rows without
    a sender have no session.

    Skew-safe sessionization, two-level like the gate: rows are ordered only
    inside (sender, time bucket); each bucket's first row finds its
    predecessor in a small per-(sender, bucket) table of first/last times
    (bounded by the time range); session numbers are prefix sums of
    session starts over that small table plus a running count in the bucket."""
    t = traffic.select(key, ts, tie).withColumn("_b", _bucket(F.col(ts), bucket_seconds))
    us = F.unix_micros(F.col(ts))
    w_in = Window.partitionBy(key, "_b").orderBy(ts, tie)
    t = t.withColumn("_prev_in", F.lag(us).over(w_in)).withColumn("_rn", F.row_number().over(w_in))
    bt = t.groupBy(key, "_b").agg(F.max(us).alias("_last"))
    w_b = Window.partitionBy(key).orderBy("_b")
    prevb = bt.select(key, "_b", F.lag("_last").over(w_b).alias("_prev_bucket_last"))
    j = t.join(prevb, [key, "_b"])
    prev = F.when(F.col("_rn") == 1, F.col("_prev_bucket_last")).otherwise(F.col("_prev_in"))
    j = j.withColumn("_start", (prev.isNull() | (us - prev > gap_seconds * 1_000_000)).cast("int"))
    starts = j.groupBy(key, "_b").agg(F.sum("_start").alias("_s"))
    w_prev = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = starts.select(key, "_b", F.coalesce(F.sum("_s").over(w_prev), F.lit(0)).alias("_off"))
    j = j.join(offs, [key, "_b"])
    w_run = Window.partitionBy(key, "_b").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("session", F.col("_off") + F.sum("_start").over(w_run))
    g = j.groupBy(key, "session").agg(F.count(F.lit(1)).alias("messages"), F.min(ts).alias("session_start"),
                                      F.max(ts).alias("session_end"))
    return g.withColumn("unusual", F.col("messages") > min_messages)
