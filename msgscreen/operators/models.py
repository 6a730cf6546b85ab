"""Model scoring, ensembles and the confidence router (M1–M7).

* M1 scores text with a caller-supplied Python scorer through ``mapInPandas``
  (Arrow batches; the scorer is built once per Python worker, not per row).
* M2/M4/M5/M7 are grouped aggregates over long prediction tables.
* M6 routes: only the rows the fast model is unsure about are handed to the
  slow model (a filter *before* the slow scorer, never score-everything).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dictionaries as D

PRED_SCHEMA = "message_id string, model string, label string, confidence double, latency_ms double, error string"


def score_with(messages: DataFrame, make_scorer: Callable[[], Callable[[list[str]], list[tuple[str, float]]]],
               model: str, text_col: str = "text", id_col: str = "message_id") -> DataFrame:
    """M1: distributed scoring with a Python model.

    ``make_scorer()`` is called once per Python worker task and returns a
    function mapping a list of texts to ``(label, confidence)`` pairs; it is
    applied to whole Arrow batches. A failing batch falls back row by row, and
    a failing row becomes an error row (ham, 0.5, latency 0).
    """
    import time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            t0 = time.perf_counter()
            try:
                out = list(scorer(texts))
                per = (time.perf_counter() - t0) * 1000.0 / max(len(texts), 1)
                labels = [o[0] for o in out]
                confs = [float(o[1]) for o in out]
                lat = [per] * len(texts)
                errs = [None] * len(texts)
            except Exception:  # isolate the failing rows
                labels, confs, lat, errs = [], [], [], []
                for t in texts:
                    t1 = time.perf_counter()
                    try:
                        lab, conf = scorer([t])[0]
                        labels.append(lab)
                        confs.append(float(conf))
                        lat.append((time.perf_counter() - t1) * 1000.0)
                        errs.append(None)
                    except Exception as e:  # noqa: BLE001
                        labels.append("ham")
                        confs.append(0.5)
                        lat.append(0.0)
                        errs.append(str(e))
            yield pd.DataFrame({"message_id": pdf[id_col].astype(str), "model": model, "label": labels,
                                "confidence": confs, "latency_ms": lat, "error": errs})

    return messages.select(F.col(id_col), F.col(text_col)).mapInPandas(run, PRED_SCHEMA)


def url_vote(url_scores: DataFrame, messages: DataFrame, id_col: str = "message_id") -> DataFrame:
    """M2: a message is spam when any of its URLs is phishing (confidence =
    max phishing confidence); URLs but none phishing -> ham 0.7; no URL ->
    ham 0.5. ``url_scores``: id, url label (phishing/benign), confidence."""
    agg = url_scores.groupBy(id_col).agg(
        F.count_if(F.col("url_label") == "phishing").alias("n_phish"),
        F.max(F.when(F.col("url_label") == "phishing", F.col("url_conf"))).alias("max_conf"))
    j = messages.select(id_col).join(agg, id_col, "left")
    return j.select(
        id_col,
        F.when(F.col("n_phish") > 0, F.lit("spam")).otherwise(F.lit("ham")).alias("label"),
        F.when(F.col("n_phish") > 0, F.col("max_conf"))
         .when(F.col("n_phish").isNotNull(), F.lit(0.7)).otherwise(F.lit(0.5)).alias("confidence"))


def _spam(c):
    return c.isin("spam", "smishing")


def voting(preds: DataFrame, id_col: str = "message_id") -> DataFrame:
    """M4: majority vote (tie -> ham); confidence = share of spam votes
    (even for a ham result). Smishing votes count as spam."""
    votes = F.sum(F.when(_spam(F.col("label")), 1).otherwise(0))
    g = preds.groupBy(id_col).agg(votes.alias("votes"), F.count(F.lit(1)).alias("n"))
    return g.select(id_col, F.when(F.col("votes") > F.col("n") / 2, F.lit("spam")).otherwise(F.lit("ham")).alias("label"),
                    (F.col("votes") / F.col("n")).alias("confidence"))


def weighted(preds: DataFrame, weights: DataFrame, id_col: str = "message_id") -> DataFrame:
    """M5: score = sum(p * c * w) with p = 1 for spam votes, c = confidence of
    the spam vote, w = normalised weight; > 0.5 -> spam, confidence = s or
    1 - s. ``weights`` has one row per model."""
    w = weights.select("model", F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy())).alias("w"))
    j = preds.join(w, "model")
    s = F.sum(F.when(_spam(F.col("label")), F.col("confidence") * F.col("w")).otherwise(F.lit(0.0)))
    g = j.groupBy(id_col).agg(s.alias("score"))
    return g.select(id_col, F.when(F.col("score") > 0.5, F.lit("spam")).otherwise(F.lit("ham")).alias("label"),
                    F.when(F.col("score") > 0.5, F.col("score")).otherwise(1.0 - F.col("score")).alias("confidence"))


def route(fast: DataFrame, slow: Callable[[DataFrame], DataFrame], threshold: float = D.ROUTER_THRESHOLD,
          id_col: str = "message_id", details: tuple[str, ...] = ()) -> DataFrame:
    """M6: keep the fast result where its confidence >= threshold; the rest
    (only the rest) goes to ``slow(df) -> (id, label, confidence)``.
    ``routed_to`` says which path answered. ``details`` are columns of the
    fast result that stay with its answers (null for the slow path's)."""
    sure = fast.filter(F.col("confidence") >= threshold)
    unsure = fast.filter(~(F.col("confidence") >= threshold))
    a = sure.select(id_col, "label", "confidence", F.lit("fast_model").alias("routed_to"), *details)
    b = slow(unsure).select(id_col, "label", "confidence", F.lit("slow_model").alias("routed_to"))
    return a.unionByName(b, allowMissingColumns=True)


def routing_stats(routed: DataFrame) -> DataFrame:
    """M7: fast and slow counts and the fast share in percent (0 if empty)."""
    fast = F.count_if(F.col("routed_to") == "fast_model")
    slow = F.count_if(F.col("routed_to") == "slow_model")
    return routed.agg(fast.alias("fast_count"), slow.alias("slow_count"),
                      F.coalesce(F.try_divide(fast * 100.0, fast + slow), F.lit(0.0)).alias("fast_percentage"))
