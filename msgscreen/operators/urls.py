"""URL analytics in exploded form.

messages → extract → ``posexplode`` → per-URL features → aggregate per message.
The exploded form suits corpus-level URL reports (U15) and is tested against
the in-row form of :mod:`msgscreen.operators.classify`; the scorer itself uses
the in-row form because it needs no shuffle.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

FEATURES = list(U.FEATURES) + ["url_risk_score"]


def url_rows(messages: DataFrame, text_col: str = "text", keep=("message_id", "sender")) -> DataFrame:
    """One row per URL occurrence: ``keep`` columns, 1-based ``pos``, ``url``."""
    keep = [c for c in keep if c in messages.columns]
    return messages.select(*keep, F.posexplode(U.extract_urls(F.col(text_col))).alias("pos", "url")) \
        .withColumn("pos", (F.col("pos") + 1).cast("long"))


@functools.lru_cache(maxsize=1)
def _feature_columns():
    """The per-URL expressions, built once (immutable, unresolved columns)."""
    return U.url_parts(F.col("url")), U.features_of_parts(F.col("p"))


def url_feature_rows(rows: DataFrame) -> DataFrame:
    """Add ``netloc``, ``path`` and the 12 features as flat columns."""
    parts_col, feats_col = _feature_columns()
    parts = rows.withColumn("p", parts_col)
    feats = parts.withColumn("f", feats_col)
    return feats.select(*rows.columns, F.col("p.dom").alias("netloc"), F.col("p.path").alias("path"),
                        *[F.col(f"f.{k}").alias(k) for k in FEATURES])


def message_url_rollup(messages: DataFrame, feats: DataFrame, id_col: str = "message_id") -> DataFrame:
    """U12 (exploded form): aggregate URL features per message, left-join back so
    messages without URLs get zeros. The aggregate is partial (map-side) then
    final; the join is a shuffle join on the message id (AQE may broadcast the
    aggregated side when it is small at runtime)."""
    agg = feats.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.max("url_risk_score").alias("max_url_risk"),
        F.avg("url_risk_score").alias("avg_url_risk"),
        F.max("is_shortener").alias("has_shortener"),
        F.max("suspicious_tld").alias("has_suspicious_tld"),
        F.max("is_ip_address").alias("has_ip_url"),
        F.max("is_legitimate_domain").alias("has_legitimate_domain"),
        F.min("has_https").alias("all_https"),
        F.max("domain_entropy").alias("max_domain_entropy"),
        F.max("has_suspicious_keywords").alias("has_suspicious_url_keywords"),
    )
    j = messages.select(id_col).join(agg, id_col, "left")
    n = F.coalesce(F.col("n_urls"), F.lit(0))
    zero = ["max_url_risk", "avg_url_risk", "has_shortener", "has_suspicious_tld", "has_ip_url",
            "has_legitimate_domain", "all_https", "max_domain_entropy", "has_suspicious_url_keywords"]
    return j.select(
        id_col,
        F.when(n > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("has_urls"),
        F.least(n / F.lit(3.0), F.lit(1.0)).alias("num_urls"),
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in zero],
    )


def netloc_rollup(feats: DataFrame) -> DataFrame:
    """Per netloc — URL occurrences, distinct messages, distinct senders,
    mean and max risk. Partial aggregation map-side; distinct counts expand
    into a two-phase aggregate, never a per-group collect."""
    return feats.groupBy("netloc").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.countDistinct("message_id").alias("n_messages"),
        F.countDistinct("sender").alias("n_senders"),
        F.round(F.avg("url_risk_score"), 6).alias("avg_risk"),
        F.round(F.max("url_risk_score"), 6).alias("max_risk"),
    )


def indicator_rollup(feats: DataFrame) -> DataFrame:
    """Per indicator string — URL occurrences, distinct messages, mean risk."""
    ind = feats.withColumn("f", F.struct(*[F.col(k) for k in FEATURES]))
    ex = ind.select("message_id", "url_risk_score", F.explode(U.indicators(F.col("f"))).alias("indicator"))
    return ex.groupBy("indicator").agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.countDistinct("message_id").alias("n_messages"),
        F.round(F.avg("url_risk_score"), 6).alias("avg_risk"),
    )


def top_domains(rollup: DataFrame, k: int = 20) -> DataFrame:
    """U15 top-k report: the k netlocs with most messages (ties by name).
    ``orderBy().limit()`` plans as TakeOrderedAndProject: a per-partition
    top-k then one k-row merge, never a global sort."""
    return rollup.orderBy(F.desc("n_messages"), F.asc("netloc")).limit(k)
