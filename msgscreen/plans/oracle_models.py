"""SQL twins of :mod:`catalog_models`. The trained classifier has none: tests compare it with a plain trainer."""

from __future__ import annotations

from .catalog_models import URL_MODEL as W
from .oracle import url_ctes, with_view
from .oracle_queries import CORPUS_CTES, SQL, TS, eval_sql, met_sql, traffic_sql
from .predictions import STRONG

_HOST = "regexp_extract(url, '^https?://([^/?#]*)', 1)"


def _count(what: str, text: str) -> str:
    return f"(length({text}) - length(replace({text}, '{what}', '')))"


_Z = (f"{W['bias']} + {W['digit']} * length(regexp_replace({_HOST}, '[^0-9]', '', 'g')) + {W['hyphen']} * {_count('-', _HOST)} + {W['dot']} * {_count('.', _HOST)}"
      f" + {W['plain']} * CASE WHEN starts_with(url, 'http:') THEN 1 ELSE 0 END + {W['query']} * {_count('=', 'url')}")
_SCORES = f""",
us AS (SELECT url, count(*) AS messages, CAST(1 / (1 + exp(-({_Z}))) AS DOUBLE) AS p FROM url_rows GROUP BY url),
ul AS (SELECT url, messages, CASE WHEN p >= 0.5 THEN 'phishing' ELSE 'benign' END AS url_label, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END AS url_conf FROM us)"""

SQL["m2_distinct_url_scores"] = with_view(url_ctes() + _SCORES + "\nSELECT url, messages, url_label, round(url_conf, 6) AS url_conf, CAST(NULL AS VARCHAR) AS error FROM ul")
SQL["m2_url_scores_grown"] = with_view(url_ctes() + _SCORES + "\nSELECT url, url_label, round(url_conf, 6) AS url_conf FROM ul")
SQL["m2_url_model_vote_scored"] = with_view(url_ctes() + _SCORES + """,
vu AS (SELECT message_id, max(CASE WHEN url_label = 'phishing' THEN url_conf END) AS conf FROM url_rows JOIN ul USING (url) GROUP BY message_id)
SELECT m.message_id, CASE WHEN vu.conf IS NOT NULL THEN 'spam' ELSE 'ham' END AS label,
  round(coalesce(vu.conf, CASE WHEN vu.message_id IS NOT NULL THEN 0.7 ELSE 0.5 END), 6) AS confidence
FROM m LEFT JOIN vu ON m.message_id = vu.message_id""")


def _quantiles(column: str) -> str:
    return ", ".join(f"round(quantile_cont({column}, {p}), 6) AS p{n}" for p, n in ((0.5, 50), (0.95, 95), (0.99, 99)))


SQL["e5_latency_percentiles"] = eval_sql("test", f"SELECT model, count(latency_ms) AS n, {_quantiles('latency_ms')} FROM al GROUP BY model")
SQL["x6_latency_percentiles"] = traffic_sql(
    f"SELECT strftime(date_trunc('hour', ts), {TS}) AS hour, event_type, count(latency_ms) AS n, {_quantiles('latency_ms')} FROM tr0 GROUP BY date_trunc('hour', ts), event_type")
SQL["x6_quantile_sketch"] = traffic_sql("SELECT date, count(latency_ms) AS n, 3 AS shares, true AS within FROM tr0 WHERE latency_ms IS NOT NULL GROUP BY date")
SQL["u15_netloc_sketches"] = f"SELECT netloc, n_urls, avg_risk, n_senders, n_messages, true AS within FROM ({SQL['u15_netloc_rollup']})"
SQL["u15_top_domains_sketch"] = f"SELECT netloc, n_urls AS count FROM ({SQL['u15_netloc_rollup']}) ORDER BY n_urls DESC, netloc LIMIT 20"
SQL["c11_bucketed_integrate"] = SQL["c11_incremental_integrate"]


def _strong_sql(split: str) -> str:
    """The strong models' predictions ``al`` on a split."""
    parts = []
    for model, digits in STRONG.items():
        miss = f"(true_label = 'spam' AND contains('{digits}', substr(md5(message_id), 1, 1)))"
        parts.append(f"SELECT message_id, '{model}' AS model, CASE WHEN {miss} THEN 'ham' ELSE true_label END AS pred, CASE WHEN {miss} THEN 0.6 ELSE 0.95 END AS confidence, "
                     f"CAST(length(message) % 31 AS DOUBLE) / 10.0 + 2.0 AS latency_ms, true_label, a2p_type, is_smishing FROM {split}")
    return " UNION ALL ".join(parts)


_STRONG = (CORPUS_CTES + ",\nsv AS (SELECT message_id, message, label AS true_label, a2p_type, is_smishing FROM cs WHERE split = 'val'),\n"
           "st AS (SELECT message_id, message, label AS true_label, a2p_type, is_smishing FROM cs WHERE split = 'test'),\n"
           f"al AS ({_strong_sql('sv')}),\nte AS ({_strong_sql('st')}),\n" + met_sql("al"))
SQL["e9_ensemble_candidates_strong"] = with_view(_STRONG + """
SELECT model, round(f1_score, 6) AS f1_score, round(f1_score / sum(f1_score) OVER (), 6) AS weight, count(*) OVER () >= 2 AS built FROM metr WHERE f1_score >= 0.9""")
SQL["m5_weighted_ensemble_strong"] = with_view(_STRONG + """,
wv AS (SELECT model, f1_score / sum(f1_score) OVER () AS w FROM metr WHERE f1_score >= 0.9 AND (SELECT count(*) FROM metr WHERE f1_score >= 0.9) >= 2),
ws AS (SELECT message_id, sum(CASE WHEN pred = 'spam' THEN confidence * w ELSE 0.0 END) AS score FROM te JOIN wv USING (model) GROUP BY message_id)
SELECT message_id, CASE WHEN score > 0.5 THEN 'spam' ELSE 'ham' END AS label, round(CASE WHEN score > 0.5 THEN score ELSE 1.0 - score END, 6) AS confidence FROM ws""")
SQL["c7_split_leaks_found"] = with_view(CORPUS_CTES + "\nSELECT message FROM cs WHERE split = 'val' AND starts_with(md5(message), '0')")
