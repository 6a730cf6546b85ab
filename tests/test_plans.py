"""Plan-shape checks: the physical plans keep the properties the design relies on."""

import re

import pytest
from pyspark.sql import functions as F

from msgscreen.operators import classify as C
from msgscreen.operators import corpus as CO
from msgscreen.plans import corpus_plan as CP
from msgscreen.plans.message_view import message_view, page_messages

from .conftest import SF0001


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_adds_no_shuffle(spark):
    mv = message_view(spark, SF0001)
    base = _plan(mv).count("Exchange")
    scored = _plan(C.batch_classify(mv))
    assert scored.count("Exchange") == base          # only the source rebalancing / broadcast side
    assert "SortMergeJoin" not in scored and "Window" not in scored


def test_dedup_is_partial_aggregate(spark):
    p = _plan(CP.corpus(spark, SF0001))
    i = p.find("Exchange hashpartitioning")
    assert i > 0 and "Aggregate" in p[i:]           # a partial aggregate below the shuffle


def test_split_has_no_single_label_window(spark):
    p = _plan(CO.stratified_split(CP.corpus(spark, SF0001)))
    # rows are ranked per (label, hash bucket); only the small bucket-count
    # table (<= labels x 16**4 rows) is ever partitioned by label alone
    assert re.search(r"hashpartitioning\(label#\d+, _b#\d+", p)


def test_column_pruning_reaches_scan(spark):
    p = _plan(C.batch_classify(message_view(spark, SF0001)))
    assert "FileScan parquet [o_orderkey" in p and "o_totalprice" not in p


def test_checkpoint_dir_from_session(spark):
    from msgscreen.session import ensure_checkpoint_dir
    d = ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()


@pytest.mark.parametrize("n", [0, 1, 7, 250, 2500])
def test_every_page_is_carried_equally_often(spark, tmp_path, n):
    """Sparse, negative and outlying page ids; every id and kind occurs."""
    from msgscreen.plans import traffic_plan as TP
    ids = [7 * i - 50 + (10**12 if i % 5 == 0 else 0) for i in range(n)]
    pages = spark.createDataFrame([(i, f"https://example.com/{i}") for i in ids], "page_id long, url string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    e = spark.range(3 * 4 * 2500).select(F.col("id").alias("event_id"))
    e.write.parquet(f"{tmp_path}/events.parquet")
    got = TP.carried_pages(spark, str(tmp_path)).collect()
    texts = {r.page_text for r in page_messages(pages).select(F.col("text").alias("page_text")).collect()}
    assert len(got) == (7500 if n else 0) and len({r.event_id for r in got}) == len(got)
    assert {r.page_text for r in got} == texts
    order = [r.text for r in page_messages(pages).withColumn("k", F.substring("message_id", 3, 20).cast("long")).orderBy("k").collect()]
    assert all(r.page_text == order[r.event_id // 4 % n] for r in got)


def test_traffic_carries_all_pages_of_the_table(spark):
    from msgscreen.plans import traffic_plan as TP
    pages = spark.read.parquet(f"{SF0001}/pages.parquet")
    want = {r.text for r in page_messages(pages).collect()}
    got = {r.body for r in TP.inbound(spark, SF0001).select("body").distinct().collect()}
    assert want <= got


def test_bodies_are_joined_only_where_they_count(spark):
    from msgscreen.operators import traffic as TR
    from msgscreen.plans import traffic_plan as TP
    assert "BroadcastNestedLoopJoin" not in _plan(TP.inbound(spark, SF0001)) and "CartesianProduct" not in _plan(TP.inbound(spark, SF0001))
    assert "page_id" not in _plan(TR.accept(TP.arrivals(spark, SF0001)))


def test_leak_check_is_one_aggregate(spark):
    split = CO.stratified_split(CP.corpus(spark, SF0001))
    assert _plan(CO.split_leaks(split)).count("Exchange hashpartitioning") <= _plan(split).count("Exchange hashpartitioning") + 2


def test_drift_scores_once(spark):
    from msgscreen.operators import monitor as MN
    from msgscreen.plans import catalog as CA
    p = _plan(MN.feature_drift(CA._drift_long(spark, SF0001)))
    assert len(re.findall(r"FileScan parquet \[event_id#\w+,ts#", p)) == 1


def test_scratch_is_dropped(spark, tmp_path):
    import os
    from msgscreen.session import drop_scratch, scratch_path
    path = scratch_path(spark, "test")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file://"))
    drop_scratch(spark)
    assert not os.path.exists(path.removeprefix("file://"))
