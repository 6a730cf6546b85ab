"""Registered queries of URL models (M2), mini-batch training (M3), percentiles (E5, X6), sketches (U15) and the bucketed corpus (C11)."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from ..operators import bucketed as BU
from ..operators import corpus as CO
from ..operators import evaluate as EV
from ..operators import minibatch as MB
from ..operators import models as MO
from ..operators import percentiles as PC
from ..operators import sketches as SK
from ..operators import urlmodel as UM
from ..operators import urls as UO
from ..session import scratch_path
from . import corpus_plan as CP
from . import predictions as PR
from . import traffic_plan as TP
from .catalog import _aligned, _round_all, _ts, r6, register
from .message_view import message_view

#: A caller's URL model for the registered queries: weights of counts in the host, and of a plain scheme.
URL_MODEL = {"bias": -2.0, "digit": 0.25, "hyphen": 0.5, "dot": 0.4, "plain": 0.8, "query": 0.3}


def lexical_url_model():
    """A scorer of whole batches of URLs, as a caller would bring it."""
    w = URL_MODEL

    def score(urls: list[str]) -> list[tuple[str, float]]:
        out = []
        for u in urls:
            host = re.match(r"https?://([^/?#]*)", u).group(1)
            z = (w["bias"] + w["digit"] * sum(c in "0123456789" for c in host) + w["hyphen"] * host.count("-") + w["dot"] * host.count(".")
                 + w["plain"] * u.startswith("http:") + w["query"] * u.count("="))
            p = 1 / (1 + math.exp(-z))
            out.append(("phishing", p) if p >= 0.5 else ("benign", 1 - p))
        return out

    return score


def _scored_urls(spark, sf_dir):
    rows = UO.url_rows(message_view(spark, sf_dir))
    return rows, UM.score_urls(rows, lexical_url_model)


@register("m2_distinct_url_scores")
def m2_scores(spark, sf_dir):
    """Each distinct URL of all messages scored once by a Python model."""
    _, scores = _scored_urls(spark, sf_dir)
    return scores.select("url", "messages", "url_label", r6(F.col("url_conf")).alias("url_conf"), "error")


@register("m2_url_model_vote_scored")
def m2_vote(spark, sf_dir):
    """The messages' votes from the table of scores; URLs in more than 100 messages count as hot here."""
    rows, scores = _scored_urls(spark, sf_dir)
    vote = UM.url_model_vote(rows, message_view(spark, sf_dir), scores, hot_rows=100)
    return vote.withColumn("confidence", r6(F.col("confidence")))


@register("m2_url_scores_grown")
def m2_grown(spark, sf_dir):
    """The same table in two deliveries: the second scores only URLs that the first hadn't."""
    path, rows = scratch_path(spark, "url-scores"), UO.url_rows(message_view(spark, sf_dir))
    UM.grow_scores(rows.where("message_id LIKE 'pg%'"), path, lexical_url_model, "first")
    grown = UM.grow_scores(rows, path, lexical_url_model, "second")
    return grown.select("url", "url_label", r6(F.col("url_conf")).alias("url_conf"))


@register("m3_loss_curve")
def m3_curve(spark, sf_dir):
    """Mini-batch training on the train split: the losses at each evaluation."""
    trained = MB.train(CP.split_corpus(spark, sf_dir))
    return spark.createDataFrame(trained.curve, MB.CURVE)


@register("m3_minibatch_classifier")
def m3_minibatch(spark, sf_dir):
    """Predictions of that training's best weights on the test split."""
    rows = CP.split_corpus(spark, sf_dir)
    return MB.train(rows).predict(rows.where("split = 'test'"))


@register("e5_latency_percentiles")
def e5(spark, sf_dir):
    """Latency percentiles per model by distributed selection."""
    p = PC.percentiles(_aligned(spark, sf_dir), ["model"], "latency_ms")
    return p.select("model", "n", *[r6(F.col("percentiles")[i]).alias(f"p{s}") for i, s in enumerate((50, 95, 99))])


@register("x6_latency_percentiles")
def x6_selection(spark, sf_dir):
    """Latency percentiles per hour and kind of request by distributed selection."""
    rows = TP.arrivals(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    p = PC.percentiles(rows, ["hour", "event_type"], "latency_ms")
    return p.select(_ts(F.col("hour")).alias("hour"), "event_type", "n", *[r6(F.col("percentiles")[i]).alias(f"p{s}") for i, s in enumerate((50, 95, 99))])


@register("x6_quantile_sketch")
def x6_sketch(spark, sf_dir):
    """Stored sketches of each hour, merged to days: is each day's estimate within the stated rank error?"""
    rows = TP.arrivals(spark, sf_dir).where("latency_ms IS NOT NULL")
    path = scratch_path(spark, "sketches")
    PC.sketches(rows, ["date", F.hour("ts").alias("hour")], "latency_ms").write.parquet(path)
    days = PC.from_sketches(PC.merged_sketches(spark.read.parquet(path), ["date"])).select("date", F.posexplode("percentiles").alias("share", "estimate"))
    counted = rows.select("date", "latency_ms").join(days, "date").groupBy("date", "share", "estimate").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("latency_ms") < F.col("estimate")).alias("below"), F.count_if(F.col("latency_ms") <= F.col("estimate")).alias("upto"))
    wanted = F.element_at(F.array(*[F.lit(p) for p in PC.SHARES]), F.col("share") + 1) * F.col("n")
    slack = F.lit(2 * PC.rank_error()) * F.col("n") + 1
    within = (F.col("below") <= wanted + slack) & (F.col("upto") >= wanted - slack)
    return counted.groupBy("date").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("shares"), F.bool_and(within).alias("within"))


@register("u15_netloc_sketches")
def u15_sketches(spark, sf_dir):
    """Distinct senders and messages per domain from eight stored parts' merged sketches: within their error?"""
    feats = UO.url_feature_rows(UO.url_rows(message_view(spark, sf_dir)))
    path = scratch_path(spark, "domains")
    SK.netloc_sketches(feats.withColumn("part", F.pmod(F.xxhash64("message_id"), F.lit(8))), ["part"]).write.parquet(path)
    e = SK.estimates(SK.merged(spark.read.parquet(path)))
    exact = UO.netloc_rollup(feats).select("netloc", "n_messages", "n_senders", F.col("n_urls").alias("n"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= SK.sender_bound(F.col(b))
    return e.join(exact, "netloc").select("netloc", "n_urls", r6(F.col("avg_risk")).alias("avg_risk"), "n_senders", "n_messages",
                                          (near("senders", "n_senders") & near("messages", "n_messages") & (F.col("n") == F.col("n_urls"))).alias("within"))


@register("u15_top_domains_sketch")
def u15_top(spark, sf_dir):
    """The twenty most frequent domains from eight stored parts' merged frequent-items sketches."""
    feats = UO.url_feature_rows(UO.url_rows(message_view(spark, sf_dir))).select("message_id", "netloc")
    path = scratch_path(spark, "frequent")
    SK.frequent_items(feats.withColumn("part", F.pmod(F.xxhash64("message_id"), F.lit(8))), "netloc", ["part"]).write.parquet(path)
    return SK.top_items(spark.read.parquet(path), 20, "netloc")


@register("c11_bucketed_integrate")
def c11_bucketed(spark, sf_dir):
    """As ``c11_incremental_integrate``, the old corpus bucketed; the batch comes in two deliveries that overlap."""
    sources = CP.corpus_sources(message_view(spark, sf_dir))
    old = CO.union_sources(sources[:2]).select(*CP.UNION_COLS)
    corpus = BU.Corpus.create(old, buckets=16)
    none = {"original_label": F.lit(None).cast("string"), "is_smishing": F.lit(False)}
    new = CO.union_sources(sources[1:])
    new = new.withColumns({k: v for k, v in none.items() if k not in new.columns}).select(*CP.UNION_COLS)
    corpus.integrate(new.where("source <> 'documents'"))
    corpus.integrate(new.where("source <> 'orders'"))
    merged = CO.stratified_split(CO.priority_dedup(corpus.table().select(*CP.UNION_COLS)))
    return merged.select("message_id", "label", "source", "split")


def _strong_metrics(spark, sf_dir):
    return EV.model_metrics(PR.strong_predictions(CP.split_corpus(spark, sf_dir).where("split = 'val'")))


@register("e9_ensemble_candidates_strong")
def e9_strong(spark, sf_dir):
    """The 0.90 rule on models of which two pass it."""
    return _round_all(EV.ensemble_candidates(_strong_metrics(spark, sf_dir)), ["f1_score", "weight"])


@register("m5_weighted_ensemble_strong")
def m5_strong(spark, sf_dir):
    """The weighted ensemble of the models that pass, on the test split."""
    weights = EV.ensemble_candidates(_strong_metrics(spark, sf_dir)).where("built").select("model", F.col("f1_score").alias("weight"))
    preds = PR.strong_predictions(CP.split_corpus(spark, sf_dir).where("split = 'test'")).withColumnRenamed("pred", "label")
    return MO.weighted(preds, weights).withColumn("confidence", r6(F.col("confidence")))


@register("c7_split_leaks_found")
def c7_leaks_found(spark, sf_dir):
    """The leak check on a split with leaks: messages of the validation split whose md5 starts with 0 are in train, too."""
    split = CP.split_corpus(spark, sf_dir)
    leak = split.where("split = 'val' AND startswith(md5(message), '0')").withColumn("split", F.lit("train"))
    return CO.split_leaks(split.unionByName(leak))
