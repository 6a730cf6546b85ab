"""Live jobs: late and shuffled rows, hot senders, state that shrinks, failures between two writes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from msgscreen.operators import traffic as TR
from msgscreen.plans import catalog_live as CL
from msgscreen.streaming import delivery as DE
from msgscreen.streaming import jobs as SJ
from msgscreen.streaming import ordered as OG
from msgscreen.streaming import stateful as ST
from msgscreen.streaming.parts import Parts

BASE = dt.datetime(2024, 1, 1)


def _feed(spark, path, schema, deliveries):
    """Each delivery is one file and one micro-batch."""
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _traffic(n=900, seed=1, delay=300):
    """Two days; a third of all rows is of one sender; arrival up to ``delay`` seconds late, in six files."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        sender = "hot" if i % 3 == 0 else None if i % 50 == 1 else f"s{rng.randrange(40)}"
        at = rng.randrange(20_000) if i % 5 else rng.randrange(40) * 500  # ties
        rows.append((i, BASE + dt.timedelta(hours=20, seconds=at), sender))
    arriving = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rng.randrange(delay)), r[0]))
    size = -(-n // 6)
    return rows, [arriving[i:i + size] for i in range(0, n, size)]


def test_rate_limit_equals_the_batch_form_with_late_rows(spark, tmp_path):
    rows, deliveries = _traffic()
    end = (None, BASE + dt.timedelta(days=9), None)
    with ST.stream_settings(spark):
        stream = _feed(spark, f"{tmp_path}/in", "event_id long, ts timestamp, sender string", [*deliveries, [end]])
        got = SJ.run_available(ST.sender_rate_stream(stream, 2, 60, "5 minutes"), f"{tmp_path}/out", f"{tmp_path}/ck")
    batch = TR.sender_rate_limit(spark.createDataFrame(rows, "event_id long, ts timestamp, sender string"), 2, 60)
    cols = ["event_id", "sender", "ts", "recent", "throttled"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, batch.select(*cols).collect()))
    assert batch.where("throttled").count() > 20


def test_settings_are_the_callers_again(spark):
    before = {k: spark.conf.get(k, None) for k in ST.STREAM_CONF}
    with ST.stream_settings(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert {k: spark.conf.get(k, None) for k in ST.STREAM_CONF} == before


def test_a_hot_sender_is_spread_by_time(spark):
    rows, _ = _traffic()
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, sender string")
    keys = df.where("sender = 'hot'").select(F.floor(F.unix_micros("ts") / 60_000_000)).distinct().count()
    assert keys > 100  # so many states instead of one


def test_sessions_merge_late_rows(spark, tmp_path):
    """A late row joins two sessions; a silence of exactly the gap doesn't end one, a microsecond more does."""
    s = dt.timedelta(seconds=1)
    first = [(1, BASE, "a"), (2, BASE + 3000 * s, "a"), (3, BASE, "b"), (4, BASE + 1800 * s, "b"), (5, BASE, "c"), (6, BASE + 1800 * s + dt.timedelta(microseconds=1), "c")]
    late = [(7, BASE + 1500 * s, "a")]
    end = [(None, BASE + dt.timedelta(days=9), None)]
    rows, deliveries = _traffic()
    schema = "event_id long, ts timestamp, sender string"
    for name, parts in (("few", [first, late, end]), ("many", [*deliveries, end])):
        with ST.stream_settings(spark):
            stream = _feed(spark, f"{tmp_path}/{name}/in", schema, parts)
            got = SJ.run_available(ST.sender_sessions_stream(stream, 1800, 2, "1 hour"), f"{tmp_path}/{name}/out", f"{tmp_path}/{name}/ck")
        want = TR.sender_sessions(spark.createDataFrame([r for p in parts[:-1] for r in p], schema), 1800, min_messages=2).drop("session")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())), name


def test_spikes_go_on_from_the_hours_before(spark, tmp_path):
    rng = random.Random(3)
    hours = [0, 0, 1, 2, 2, 3, *[30] * 9, 31, 58, *[60] * 5, 61, 90]
    rows = [(i, BASE + dt.timedelta(hours=h, minutes=rng.randrange(60)), i % 7 == 0) for i, h in enumerate(hours)]
    schema = "event_id long, ts timestamp, is_error boolean"
    cuts = [rows[:5], rows[5:16], rows[16:20], rows[20:]]
    stream = _feed(spark, f"{tmp_path}/in", schema, [*cuts, [(None, BASE + dt.timedelta(days=30), False)]])
    with ST.stream_settings(spark):
        ST.start_volume_spikes(stream, f"{tmp_path}/out", f"{tmp_path}/ck", 24, 1.5).awaitTermination()
    got = ST.read_spikes(spark, f"{tmp_path}/out")
    want = TR.volume_spikes(spark.createDataFrame(rows, schema), 24, 1.5).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("spike").count() > 1


def _gate_rows(spark, seed):
    """Messages and overrides of two days, both up to an hour late."""
    rng = random.Random(seed)
    line = [(i, BASE + dt.timedelta(seconds=rng.randrange(2 * 86400)), None) for i in range(150)]
    line += [(1000 + i, BASE + dt.timedelta(seconds=rng.randrange(2 * 86400)), rng.choice(["enable", "disable"])) for i in range(12)]
    line = [(i, t, t.date(), None if a else 1, a) for i, t, a in line]
    arriving = sorted(line, key=lambda r: (r[1] + dt.timedelta(seconds=rng.randrange(3500)), r[0]))
    return line, [[(i, t, d, c and __import__("decimal").Decimal("1.0000"), a) for i, t, d, c, a in arriving[k:k + 30]] for k in range(0, len(arriving), 60)]


@pytest.mark.parametrize("seed", [1])
def test_gate_with_rows_and_overrides_out_of_order(spark, tmp_path, seed):
    _, deliveries = _gate_rows(spark, seed)
    stream = _feed(spark, f"{tmp_path}/in", OG.ROWS, deliveries)
    OG.start_ordered_gate(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "20.00", dt.timedelta(hours=1)).awaitTermination()
    decided = OG.read_gate(spark, f"{tmp_path}/out").count()
    OG.close_gate(spark, f"{tmp_path}/out", "20.00")
    got = OG.read_gate(spark, f"{tmp_path}/out")
    rows = spark.read.schema(OG.ROWS).parquet(f"{tmp_path}/in")
    want = TR.apply_overrides(rows.where("action IS NULL").drop("action"), rows.where("action IS NOT NULL").drop("cost"), limit="20.00")
    cols = ["event_id", "override", "accepted", "alert", "spend_before"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect()))
    assert 0 < decided < 150 and got.where("NOT accepted").count() > 0 and OG.read_late(spark, f"{tmp_path}/out").count() == 0
    parts = Parts(spark, f"{tmp_path}/out")  # only the last state and buffer are kept
    assert len(parts._names("state")) <= 2 and len(parts._names("buffer")) <= 2 and parts.read("state", TR.STATE, [parts.last()]).count() <= 2


def test_rows_behind_the_frontier_change_nothing(spark, tmp_path):
    row = lambda i, s: (i, BASE + dt.timedelta(seconds=s), BASE.date(), __import__("decimal").Decimal("1.0000"), None)
    stream = _feed(spark, f"{tmp_path}/in", OG.ROWS, [[row(1, 0), row(2, 5000)], [row(3, 100), row(4, 4990)]])
    OG.start_ordered_gate(stream, f"{tmp_path}/out", f"{tmp_path}/ck", "2.00", dt.timedelta(minutes=1)).awaitTermination()
    OG.close_gate(spark, f"{tmp_path}/out", "2.00")
    assert [r.event_id for r in OG.read_late(spark, f"{tmp_path}/out").collect()] == [3]
    assert {r.event_id: (r.accepted, r.alert) for r in OG.read_gate(spark, f"{tmp_path}/out").collect()} == {1: (True, False), 4: (True, True), 2: (False, False)}


def _classified_feed(spark, path, deliveries=4):
    rows = [[(25 * d + i, BASE + dt.timedelta(minutes=d * 30 + i), f"+1{i}", f"hello {i} http://bit.ly/x", "error" if i % 9 == 0 else "signup", 1.0, f"SM{25 * d + i}") for i in range(25)]
            for d in range(deliveries)]
    return SJ.classify_stream(_feed(spark, path, SJ.INBOUND_SCHEMA, rows))


@pytest.mark.parametrize("dies_at", ["scored", "outbox", "history"])
def test_outbox_and_history_commit_together(spark, tmp_path, dies_at):
    died = []

    def between(name, n):
        if name == dies_at and n == 2 and not died:
            died.append(n)
            raise RuntimeError("killed")

    out, check = f"{tmp_path}/out", f"{tmp_path}/ck"
    feed = _classified_feed(spark, f"{tmp_path}/in")
    with pytest.raises(Exception, match="killed"):
        DE.start_outbox(feed, out, check, "salt", between=between).awaitTermination()
    assert died and DE.read_outbox(spark, out).count() == 50  # the two whole batches
    ids = {r.event_id for r in DE.read_history(spark, out).collect()}
    assert ids <= {r.event_id for r in DE.read_outbox(spark, out).collect()}
    DE.start_outbox(feed, out, check, "salt", between=between).awaitTermination()
    box, history = DE.read_outbox(spark, out), DE.read_history(spark, out)
    assert sorted(r.event_id for r in box.collect()) == list(range(100))
    assert sorted(r.event_id for r in history.collect()) == [i for i in range(100) if i % 25 % 9]
    assert "sender" not in history.columns and history.where("length(from_number_hash) = 64").count() == history.count()


def test_a_committed_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    """As after a loss between our commit record and Spark's own."""
    import shutil
    out, check = f"{tmp_path}/out", f"{tmp_path}/ck"
    _, deliveries = _gate_rows(spark, 7)
    stream = _feed(spark, f"{tmp_path}/in", OG.ROWS, deliveries)
    OG.start_ordered_gate(stream, out, check, "20.00", dt.timedelta(hours=1)).awaitTermination()
    before = sorted(map(str, OG.read_gate(spark, out).collect()))
    last = max(int(p.name) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "ck" / "commits" / str(last)).rename(tmp_path / f"lost-{last}")
    crc = tmp_path / "ck" / "commits" / f".{last}.crc"
    if crc.exists():
        shutil.move(str(crc), str(tmp_path / "lost-crc"))
    OG.start_ordered_gate(stream, out, check, "20.00", dt.timedelta(hours=1)).awaitTermination()
    assert sorted(map(str, OG.read_gate(spark, out).collect())) == before


def test_upserted_windows_and_a_state_that_shrinks(spark, tmp_path):
    rows = [[(i, BASE + dt.timedelta(days=d, minutes=i), "x", "hello", "signup", 1.0, f"SM{d}-{i}") for i in range(30)] for d in range(6)]
    rows[3].append((99, BASE + dt.timedelta(days=2, hours=23), "x", "hello", "signup", 1.0, "late"))
    feed = SJ.inbound_stream
    path = f"{tmp_path}/in"
    for part in rows:
        spark.createDataFrame(part, SJ.INBOUND_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    windows = SJ.daily_counters_stream(SJ.classify_stream(feed(spark, path, max_files=1), "12 hours"))
    q = DE.start_upsert(windows, ["date"], f"{tmp_path}/out", f"{tmp_path}/ck", fold_every=3)
    q.awaitTermination()
    got = {str(r.date): r.total_messages for r in DE.read_upserted(spark, f"{tmp_path}/out", DE.ddl(windows), ["date"]).collect()}
    assert got == {f"2024-01-0{d + 1}": 31 if d == 2 else 30 for d in range(6)}
    state = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert state < 6, "the state store forgets windows behind the watermark"
    assert len(Parts(spark, f"{tmp_path}/out")._names("base")) >= 1


def test_feedback_chain_hands_on_exactly_a_hundred(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"text {rng.randrange(260)}", "spam" if i % 3 else "ham", BASE + dt.timedelta(seconds=i // 2)) for i in range(345)]
    corpus = spark.createDataFrame([(f"text {i}", "ham") for i in range(0, 300, 2)], "message string, label string")
    seen, dies = [], [True]

    def retrain(k, made):
        seen.append((k, made.count()))
        if k == 1 and dies:
            dies.clear()
            raise RuntimeError("killed")

    stream = _feed(spark, f"{tmp_path}/in", DE.FEEDBACK, [rows[:40], rows[40:250], rows[250:251], rows[251:]])
    out = f"{tmp_path}/out"
    with pytest.raises(Exception, match="killed"):
        DE.start_feedback_chain(stream, out, f"{tmp_path}/ck", corpus, 100, retrain).awaitTermination()
    assert DE.read_corrections(spark, out).count() == 0  # nothing of the batch that died
    DE.start_feedback_chain(stream, out, f"{tmp_path}/ck", corpus, 100, retrain).awaitTermination()
    taken = DE.read_corrections(spark, out)
    by = {}
    for r in taken.collect():
        by.setdefault(r.trigger, set()).add(r.feedback_id)
    assert by == {k: set(range(100 * k, 100 * k + 100)) for k in range(3)}
    assert sorted({k for k, _ in seen}) == [0, 1, 2]
    batch = TR.feedback_triggers(spark.createDataFrame(rows, DE.FEEDBACK)).collect()
    live = taken.groupBy("trigger").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()
    assert {(r.batch, r.first_ts, r.trigger_ts) for r in batch} == {(r.trigger, r.a, r.b) for r in live}
    for k in range(3):
        made = DE.read_retraining_sets(spark, out).where(F.col("trigger") == k)
        texts = {rows[i][1] for i in by[k]}
        assert made.where("origin = 'feedback'").count() == len(texts) and made.count() == len(texts | {f"text {i}" for i in range(0, 300, 2)})


def test_deliveries_cover_all_rows(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 60).alias("ts"))
    CL._deliver(rows, f"{tmp_path}/in", shuffled=True)
    assert spark.read.parquet(f"{tmp_path}/in").distinct().count() == 1000


def test_sets_of_many_triggers_are_stored_once(spark, tmp_path):
    """Two runs: the tables hold the corpus once a run, not once a trigger; the sets and their sizes are C12's."""
    rng = random.Random(8)
    rows = [(i, None if i % 40 == 7 else f"text {rng.randrange(150)}", "spam" if i % 3 else "ham", BASE + dt.timedelta(seconds=i)) for i in range(150)]
    corpora = [spark.createDataFrame([(None if i == 1 else f"text {i}", "ham") for i in range(0, 200, step)] + [("text 0", "a")], "message string, label string") for step in (1, 3)]
    out = f"{tmp_path}/out"
    for run, (part, corpus) in enumerate(zip((rows[:80], rows[80:]), corpora, strict=True)):
        stream = _feed(spark, f"{tmp_path}/in", DE.FEEDBACK, [part])
        DE.start_feedback_chain(stream, out, f"{tmp_path}/ck", corpus, 10).awaitTermination()
    parts, sizes = Parts(spark, out), {r.trigger: r for r in DE.retraining_set_sizes(spark, out).collect()}
    assert parts.read("base", DE.BASE).count() == 200 + 67 and parts.read("changes", DE.CHANGES).count() <= 150 and len(sizes) == 15
    sets, taken = DE.read_retraining_sets(spark, out), DE.read_corrections(spark, out)
    from msgscreen.operators import corpus as CO
    for k in (0, 4, 7, 8, 14):
        want = CO.retraining_set(corpora[k >= 8], taken.where(F.col("trigger") == k))
        got = sets.where(F.col("trigger") == k).drop("trigger")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), k
        assert (sizes[k].from_feedback, sizes[k].from_corpus) == (want.where("origin = 'feedback'").count(), want.where("origin = 'corpus'").count())


def test_many_senders_share_states(spark, tmp_path):
    """5,000 senders in three buckets: a state a shard and bucket, not a sender and bucket; answers are the batch form's."""
    schema = "event_id long, ts timestamp, sender string"
    rows = [(i, BASE + dt.timedelta(seconds=i % 170), None if i % 97 == 0 else f"s{i * 7919 % 5000}") for i in range(9000)]
    rows += [(9000 + i, BASE + dt.timedelta(seconds=60 * (i % 3), microseconds=i % 2), "s1") for i in range(30)]  # at the buckets' edges
    stream = _feed(spark, f"{tmp_path}/in", schema, [rows, [(None, BASE + dt.timedelta(days=9), None)]])
    with ST.stream_settings(spark):
        q = (ST.sender_rate_stream(stream, 1, 60, "1 minute").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    updated = max(p["stateOperators"][0]["numRowsUpdated"] for p in q.recentProgress if p["stateOperators"])
    assert updated < 5 * 4 * ST.RATE_SHARDS  # chunks and timers of four buckets
    batch = TR.sender_rate_limit(spark.createDataFrame(rows, schema), 1, 60)
    cols = ["event_id", "sender", "ts", "recent", "throttled"]
    assert sorted(map(str, spark.read.schema(batch.select(*cols).schema).parquet(f"{tmp_path}/out").select(*cols).collect())) == sorted(map(str, batch.select(*cols).collect()))


@pytest.mark.parametrize("ties", [1, 900])
def test_large_deliveries_are_several_files_and_one_batch_each(spark, tmp_path, ties):
    """Also where most rows arrive at once, so that other deliveries are smaller or empty."""
    second = F.when(F.col("id") < ties, 0).otherwise(F.col("id"))
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + second * 60).alias("ts"))
    stream, seen = CL._deliver(rows, f"{tmp_path}/in", shuffled=False, files=6, file_rows=50), []

    def step(batch, n):
        seen.append(tuple(batch.agg(F.count(F.lit(1)), F.count_distinct("file"), F.min("ts"), F.max("ts")).first()))

    stream.withColumn("file", F.input_file_name()).writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sum(s[0] for s in seen) == 1000 and len(seen) == 6
    held = [s for s in seen if s[0]]
    assert all(a[3] < b[2] for a, b in zip(held, held[1:], strict=False))
    assert [s[1] for s in held] == [4] * 6 if ties == 1 else held[0][1] > 10 and len(held) < 6
