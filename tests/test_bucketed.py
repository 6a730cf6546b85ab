"""The bucketed corpus and the mergeable sketches."""

import random

import pytest
from pyspark.sql import functions as F

from msgscreen.operators import bucketed as BU
from msgscreen.operators import corpus as CO
from msgscreen.operators import sketches as SK

COLS = "message_id string, message string, label string, source string, quality string, source_rank int"


def _rows(spark, texts, source, rank):
    return spark.createDataFrame([(f"{source}{i}", t, "ham", source, "high", rank) for i, t in enumerate(texts)], COLS)


def test_integrate_equals_the_plain_form(spark, tmp_path):
    rng = random.Random(1)
    old = [f"old {i % 400}" for i in range(500)] + [None]
    new = [f"old {rng.randrange(600)}" for _ in range(300)] + ["hot"] * 300 + [None, "", "é" * 500]  # a third is one text
    a, b = _rows(spark, old, "a", 0), _rows(spark, new, "b", 1)
    corpus = BU.Corpus.create(a, 4, str(tmp_path / "c"))
    added = corpus.integrate(b)
    want = CO.integrate(a.where("message IS NOT NULL"), CO.priority_dedup(b.where("message IS NOT NULL")).drop("quality_rank"))
    got = corpus.table().drop("text_hash").select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert added.count() == len({t for t in new if t is not None} - set(old))
    assert corpus.integrate(b).count() == 0 and corpus.integrate(b.where("false")).count() == 0
    assert corpus.integrate(_rows(spark, ["later", "hot"], "c", 2)).select("message").collect() == [("later",)]
    corpus.drop()


def test_the_old_corpus_is_not_shuffled(spark, tmp_path):
    corpus = BU.Corpus.create(_rows(spark, [f"old {i}" for i in range(200)], "a", 0), 4, str(tmp_path / "c"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    try:
        new = _rows(spark, [f"old {i}" for i in range(150, 300)], "b", 1).withColumn("text_hash", F.xxhash64("message"))
        left = corpus.split_known(new).where("maybe_known").drop("maybe_known")
        plan = left.join(corpus.table().select("text_hash", "message"), ["text_hash", "message"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    join = plan[plan.index("SortMergeJoin"):]
    old = join[join.index("Bucketed: true") - 600:]
    assert "SelectedBucketsCount: 4 out of 4" in plan
    # one exchange by key, that of the new rows; the scan of the corpus has none above it
    assert join.count("Exchange hashpartitioning(text_hash") == 1 and "Exchange" not in join[join.rindex("Sort ["):]
    assert old
    corpus.drop()


def test_the_filter_knows_every_text(spark, tmp_path):
    texts = [f"t{i}" for i in range(3000)]
    corpus = BU.Corpus.create(_rows(spark, texts, "a", 0), 4, str(tmp_path / "c"))
    probe = _rows(spark, texts + [f"u{i}" for i in range(3000)], "b", 1).withColumn("text_hash", F.xxhash64("message"))
    seen = corpus.split_known(probe)
    assert seen.count() == 6000 and seen.where("message LIKE 't%' AND NOT maybe_known").count() == 0
    assert seen.where("message LIKE 'u%' AND maybe_known").count() < 30
    corpus.drop()


@pytest.mark.parametrize("parts", [1, 6])
def test_sketches_within_their_error(spark, parts):
    df = spark.range(60_000).select(F.concat(F.lit("d"), (F.pow(F.rand(3), 3) * 50).cast("int")).alias("netloc"), (F.col("id") * 7919 % 20_011).cast("string").alias("sender"),
                                    F.col("id").cast("string").alias("message_id"), F.lit(0.5).alias("url_risk_score"), (F.col("id") % parts).alias("part")).cache()
    est = SK.estimates(SK.merged(SK.netloc_sketches(df, ["part"]))).collect()
    exact = {r.netloc: r for r in df.groupBy("netloc").agg(F.count_distinct("sender").alias("s"), F.count_distinct("message_id").alias("m"), F.count("*").alias("n")).collect()}
    assert len(est) == len(exact)
    for r in est:
        e = exact[r.netloc]
        assert r.n_urls == e.n and abs(r.senders - e.s) <= SK.sender_bound(e.s) and abs(r.messages - e.m) <= SK.sender_bound(e.m) and r.avg_risk == 0.5


def test_frequent_items_within_their_error(spark):
    """Many more items than are tracked; the heavy ones are found, counts within the stated share of all rows."""
    n, tracked = 100_000, 512
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 10 == 1, F.concat(F.lit("w"), (F.col("id") % 4).cast("string")))
                               .otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("item_name"), (F.col("id") % 5).alias("part")).cache()
    exact = {r.item_name: r["count"] for r in df.groupBy("item_name").count().collect()}
    top = SK.top_items(SK.frequent_items(df, "item_name", ["part"], tracked), 3, tracked=tracked).collect()
    assert top[0].item == "hot" and {r.item for r in top} <= {"hot", "w1", "w3", "w0", "w2"}
    assert all(abs(r["count"] - exact[r.item]) <= 3.5 / tracked * n for r in top)
