"""Prediction tables derived from the split corpus (inputs of E and M jobs).

Three models score every corpus message:
* ``rules``    — the rule scorer (H3/H4), latency = (length % 97) / 10 ms;
* ``hash_model`` — spam when the first hex digit of md5(message_id) < 4,
  confidence 0.9 / 0.7, and an error row (ham, 0.5, 0 ms) when the third
  digit is ``f``; latency = (length % 389) / 10 + 5 ms;
* ``keyword_model`` — spam when the text has 'free' or '$', confidence 0.8 /
  0.6, latency = (length % 53) / 10 + 1 ms.
All are deterministic functions of the data, so the DuckDB oracle can
rebuild them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify as C
from ..operators.evaluate import fold
from ..session import materialize
from .corpus_plan import split_corpus

MODELS = ["rules", "hash_model", "keyword_model"]


def _lat(mod: int, add: float = 0.0):
    return (F.length("message") % mod).cast("double") / 10.0 + F.lit(add)


def rules_predictions(sc: DataFrame, scored: bool = False):
    """Column list of the rule model (``scored``: ``sc`` already went through
    the scorer); as a DataFrame when called on an unscored table."""
    cols = [F.col("message_id"), F.lit("rules").alias("model"), F.col("label"), F.col("confidence"),
            _lat(97).alias("latency_ms"), F.lit(None).cast("string").alias("error")]
    if scored:
        return cols
    return C.score(sc, text_col="message").select(*cols)


def hash_predictions(sc: DataFrame):
    h = F.md5(F.col("message_id"))
    err = F.substring(h, 3, 1) == "f"
    return [
        F.col("message_id"), F.lit("hash_model").alias("model"),
        F.when(err, F.lit("ham")).when(F.substring(h, 1, 1) < "4", F.lit("spam")).otherwise(F.lit("ham")).alias("label"),
        F.when(err, F.lit(0.5)).when(F.substring(h, 2, 1) < "8", F.lit(0.9)).otherwise(F.lit(0.7)).alias("confidence"),
        F.when(err, F.lit(0.0)).otherwise(_lat(389, 5.0)).alias("latency_ms"),
        F.when(err, F.lit("timeout")).alias("error")]


def near_truth_columns(model: str, digits: str):
    """A model that misses the spam whose md5(message_id) starts with one of ``digits`` and knows all else."""
    miss = (F.col("true_label") == "spam") & F.substring(F.md5("message_id"), 1, 1).isin(*digits)
    return [
        F.col("message_id"), F.lit(model).alias("model"), F.when(miss, F.lit("ham")).otherwise(F.col("true_label")).alias("label"),
        F.when(miss, F.lit(0.6)).otherwise(F.lit(0.95)).alias("confidence"), _lat(31, 2.0).alias("latency_ms"), F.lit(None).cast("string").alias("error")]


#: Models above the ensembles' 0.90 rule, and one below it.
STRONG = {"near_truth": "0", "less_near": "12", "far": "01234567"}


def strong_predictions(sc: DataFrame) -> DataFrame:
    """Predictions of the models in ``STRONG`` beside the truth (the shape of the aligned table)."""
    s = sc.withColumn("true_label", F.col("label"))
    structs = [F.struct(*near_truth_columns(m, d)) for m, d in STRONG.items()]
    x = s.select("true_label", "a2p_type", "is_smishing", F.explode(F.array(*structs)).alias("p"))
    return x.select("p.message_id", "p.model", F.col("p.label").alias("pred"), "p.confidence", "p.latency_ms", "p.error", "true_label", "a2p_type", "is_smishing")


def keyword_columns():
    hit = F.lower("message").contains("free") | F.col("message").contains("$")
    return [
        F.col("message_id"), F.lit("keyword_model").alias("model"),
        F.when(hit, F.lit("spam")).otherwise(F.lit("ham")).alias("label"),
        F.when(hit, F.lit(0.8)).otherwise(F.lit(0.6)).alias("confidence"),
        _lat(53, 1.0).alias("latency_ms"), F.lit(None).cast("string").alias("error")]


def keyword_predictions(sc: DataFrame) -> DataFrame:
    """The keyword model as a DataFrame (used as the router's slow path)."""
    return sc.select(*keyword_columns())


def predictions(sc: DataFrame) -> DataFrame:
    """All three models in one pass over ``sc``: each scored row emits an
    array of three prediction structs that is exploded (no 3-way union, so
    the input is read once)."""
    s = C.score(sc, text_col="message")
    structs = [F.struct(*cols) for cols in (rules_predictions(s, scored=True), hash_predictions(s),
                                            keyword_columns())]
    return s.select(F.explode(F.array(*structs)).alias("p")).select("p.*")


def corpus_and_predictions(spark: SparkSession, sf_dir: str, split: str | None = "test"):
    """The (checkpointed) corpus rows of one split and their predictions."""
    sc = split_corpus(spark, sf_dir)
    if split:
        sc = sc.filter(F.col("split") == split)
    sc = materialize(sc)
    return sc, predictions(sc)


def predictions_with_truth(sc: DataFrame) -> DataFrame:
    """The models' predictions of each corpus row beside its truth (the shape
    of the aligned table), in one pass over ``sc``."""
    s = C.score(sc.withColumns({"true_label": F.col("label"), "true_smishing": F.col("is_smishing")}), text_col="message")
    structs = [F.struct(*cols) for cols in (rules_predictions(s, scored=True), hash_predictions(s), keyword_columns())]
    x = s.select("true_label", "a2p_type", "true_smishing", F.explode(F.array(*structs)).alias("p"))
    return x.select("p.message_id", "p.model", fold(F.col("p.label")).alias("pred"), "p.confidence", "p.latency_ms", "p.error",
                    "true_label", "a2p_type", F.col("true_smishing").alias("is_smishing"))
