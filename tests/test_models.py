"""URL models, mini-batch training and percentiles against plain versions."""

import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from msgscreen.operators import minibatch as MB
from msgscreen.operators import percentiles as PC
from msgscreen.operators import urlmodel as UM
from msgscreen.operators.models import url_vote


def _url_rows(spark):
    """A third of the rows is one URL; some messages have several."""
    rng = random.Random(2)
    rows = [(f"m{i}", 1, "http://hot.example/x") for i in range(300)]
    rows += [(f"m{rng.randrange(400)}", 2 + i % 3, f"https://h{rng.randrange(90)}.example/p?a=1") for i in range(600)]
    return spark.createDataFrame(rows, "message_id string, pos long, url string").repartition(5)


def _counting_scorer(calls):
    def make():
        def score(urls):
            calls.add(len(urls))
            if any("h7." in u for u in urls):
                raise ValueError("h7")
            return [("phishing", 0.9) if "hot" in u or "h1" in u else ("benign", 0.8) for u in urls]
        return score
    return make


@pytest.mark.parametrize("hot_rows", [10, 100_000])
def test_each_distinct_url_is_scored_once(spark, hot_rows):
    rows = _url_rows(spark)
    messages = spark.createDataFrame([(f"m{i}",) for i in range(420)], "message_id string")
    calls = spark.sparkContext.accumulator(0)
    # batches with h7 are scored again row by row: count only those without
    clean = rows.where("url NOT LIKE '%h7.%'")
    scores = UM.score_urls(clean, _counting_scorer(calls))
    distinct = clean.select("url").distinct().count()
    assert calls.value == distinct == scores.count()
    scores = UM.score_urls(rows, _counting_scorer(calls))
    assert scores.where("error IS NOT NULL").count() == 1 and scores.where("url_label IS NULL").count() == 1
    got = UM.url_model_vote(rows, messages, scores, hot_rows=hot_rows)
    known = scores.where("url_label IS NOT NULL").select("url", "url_label", "url_conf")
    want = url_vote(rows.join(known, "url"), messages)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 420 and UM.url_model_vote(rows.where("false"), messages, scores).where("confidence <> 0.5").count() == 0


def test_hot_urls_rows_are_not_shuffled_to_their_score(spark):
    rows = _url_rows(spark)
    scores = UM.score_urls(rows.where("url NOT LIKE '%h7.%'"), _counting_scorer(spark.sparkContext.accumulator(0)))
    joined = UM.with_scores(rows, scores, hot_rows=100).withColumn("p", F.spark_partition_id())
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("url LIKE '%hot%'").count() == 300


def test_a_kept_table_of_scores_grows_by_new_urls(spark, tmp_path):
    rows, path = _url_rows(spark).where("url NOT LIKE '%h7.%'"), str(tmp_path / "scores")
    first = rows.where("pos < 3")
    calls = spark.sparkContext.accumulator(0)
    UM.grow_scores(first, path, _counting_scorer(calls), "a")
    n = calls.value
    assert n == first.select("url").distinct().count()
    for _ in range(2):  # the second time as after a lost driver: the part replaces itself
        grown = UM.grow_scores(rows, path, _counting_scorer(calls), "b")
    new = rows.select("url").distinct().count() - n
    assert calls.value == n + 2 * new and grown.count() == grown.select("url").distinct().count() == n + new
    assert sorted(os.listdir(path)) == ["batch=a", "batch=b"]


def _corpus(spark, flip):
    """Spam words decide; in ``val`` the labels may be the wrong way round, so that its loss grows."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        spam = rng.random() < 0.4
        text = " ".join(rng.choice(["win", "cash", "free", "prize"] if spam and rng.random() < 0.7 else ["hello", "lunch", "Meeting", "tomorrow", "ok"]) for _ in range(rng.randrange(1, 9)))
        split = ["train", "train", "train", "val", "test"][i % 5]
        label = ("spam" if spam else "ham") if not (flip and split == "val") else ("ham" if spam else "spam")
        rows.append((f"id{i}", text, label, split))
    rows += [("null", None, "ham", "train"), ("empty", "", "ham", "train"), ("bare", "win cash", None, "val")]
    return spark.createDataFrame(rows, "message_id string, message string, label string, split string")


def _twin(rows, rules):
    """The same rules on dense rows, one after the other."""
    data = [(r.tokens, r.y, r.split, r.batch) for r in rows]
    weights, first, second = (np.zeros(MB.DIMS + 1) for _ in range(3))

    def predict(tokens):
        z = sum(weights[t] / math.sqrt(len(tokens)) for t in tokens) + weights[-1]
        return 1 / (1 + math.exp(-z))

    def loss(part):
        out = [-(y * math.log(p) + (1 - y) * math.log(1 - p)) for t, y, _, _ in part for p in [min(max(predict(t), 1e-12), 1 - 1e-12)]]
        return sum(out) / len(out)

    curve, step, updates, best, waited = [], 0, 0, float("inf"), 0
    for epoch in range(rules.epochs):
        for b in np.random.default_rng((rules.seed, epoch)).permutation(rules.steps).tolist():
            step += 1
            rate = rules.rate * step / rules.warm_up if step <= rules.warm_up else rules.rate * (rules.total - step) / (rules.total - rules.warm_up)
            part = [d for d in data if d[2] == "train" and d[3] == b]
            before = loss(part) if part else None
            if part:
                g = np.zeros(MB.DIMS + 1)
                for t, y, _, _ in part:
                    e = predict(t) - y
                    for x in t:
                        g[x] += e / math.sqrt(len(t))
                    g[-1] += e
                g /= len(part)
                updates += 1
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                shrink = np.full(MB.DIMS + 1, 1 - rate * rules.decay)
                shrink[-1] = 1
                weights = weights * shrink - rate * (first / (1 - 0.9**updates)) / (np.sqrt(second / (1 - 0.999**updates)) + 1e-8)
            if step % rules.eval_every == 0 or step == rules.total:
                held = loss([d for d in data if d[2] == "val"])
                better = held < best
                best, waited = (held, 0) if better else (best, waited + 1)
                curve.append((step, epoch, rate, before, held, better, waited >= rules.patience))
                if waited >= rules.patience:
                    return curve
    return curve


@pytest.mark.parametrize("flip", [False, True])
def test_minibatch_training_follows_the_plain_trainer(spark, flip):
    corpus = _corpus(spark, flip)
    rules = MB.Rules(epochs=2, steps=8, rate=0.3, warm_up=3, eval_every=2, patience=3)
    trained = MB.train(corpus, rules)
    want = _twin(MB.prepare(corpus, rules).collect(), rules)
    assert len(trained.curve) == len(want)
    for a, b in zip(trained.curve, want, strict=True):
        assert a[:2] == b[:2] and a[5:] == b[5:] and np.allclose(a[2:5], b[2:5], rtol=1e-9)
    if flip:  # the loss on val only grows: best first, then three without a better one
        assert [c[5] for c in trained.curve] == [True, False, False, False] and trained.curve[-1][6]
    else:
        out = trained.predict(corpus.where("split = 'test'")).join(corpus.withColumnRenamed("label", "truth"), "message_id")
        assert out.where("label = truth").count() > 0.85 * out.count() and out.where("confidence < 0.5").count() == 0


def test_a_step_reads_its_own_batch(spark):
    rows = MB.prepare(_corpus(spark, False), MB.Rules(steps=8))
    assert rows.where("batch IS NULL").count() == 0 and rows.select("batch").distinct().count() == 8
    assert rows.where("size(tokens) = 0").count() == 1          # the empty message


def test_each_step_opens_only_its_batchs_files(spark, monkeypatch):
    opened, gradient = [], MB._gradient

    def noted(batch, weights):
        opened.append(re.findall(r"PartitionFilters: \[[^\]]*batch#\d+ = (\d+)\)", batch._jdf.queryExecution().executedPlan().toString()))
        return gradient(batch, weights)

    monkeypatch.setattr(MB, "_gradient", noted)
    rules = MB.Rules(epochs=1, steps=8, warm_up=3, eval_every=8)
    MB.train(_corpus(spark, False), rules)
    assert opened == [[str(b)] for b in rules.order(0)]


def test_percentiles_equal_the_builtin(spark):
    n = 40_000
    g = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 1, None).otherwise(F.col("id") % 50)  # one group holds a third
    v = (F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 1009 == 5, 1e15).when(F.col("id") % 2 == 0, F.round(F.randn(1), 1)).otherwise(F.randn(2) * 1e-3))
    df = spark.range(n).select(g.alias("g"), (F.col("id") % 2).alias("h"), v.alias("v")).cache()
    shares = (0.0, 0.25, 0.5, 0.95, 0.99, 1.0)
    want = df.groupBy("g", "h").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, shares))).alias("p")).where("n > 0")
    got = PC.percentiles(df, ["g", "h"], "v", shares, "p")
    assert {(r.g, r.h): (r.n, r.p) for r in got.collect()} == {(r.g, r.h): (r.n, r.p) for r in want.collect()}
    whole = PC.percentiles(df, [], "v", (0.5,), "p").first()
    assert whole.p[0] == df.agg(F.percentile("v", F.lit(0.5)).alias("p")).first().p
    assert PC.percentiles(df.where("v IS NULL"), ["g"], "v").count() == 0
    few = spark.createDataFrame([(1, 5.0), (1, None), (2, 1.0), (2, 2.0)], "g int, v double")
    assert {r.g: r.p for r in PC.percentiles(few, ["g"], "v", (0.5,), "p").collect()} == {1: [5.0], 2: [1.5]}


def test_no_task_holds_a_groups_values(spark):
    plan = PC.percentiles(spark.range(10).select(F.lit(1).alias("g"), F.col("id").alias("v")), ["g"], "v")._jdf.queryExecution().toString()
    assert "percentile(" not in plan.split("== Analyzed")[0] and "collect_list(v" not in plan


def test_merged_sketches_keep_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 40).alias("hour"), (F.randn(5) * 10).alias("v")).cache()
    est = PC.from_sketches(PC.merged_sketches(PC.sketches(df, ["hour"], "v"), [])).first().percentiles
    for p, e in zip(PC.SHARES, est, strict=True):
        assert abs(df.where(F.col("v") <= e).count() / 60_000 - p) <= 2 * PC.rank_error()
