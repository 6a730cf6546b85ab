"""DuckDB SQL for each registered query (keys match :mod:`catalog`)."""

from __future__ import annotations

from .. import dictionaries as D
from .traffic_plan import LIMIT
from .oracle import q, r6, rollup_ctes, scored_ctes, url_ctes, with_view

SQL: dict[str, str] = {}

FEATURES = [k for k, _ in D.URL_RISK_WEIGHTS] + ["url_risk_score"]
ROLLUP_COLS = ["has_urls", "num_urls", "max_url_risk", "avg_url_risk", "has_shortener",
               "has_suspicious_tld", "has_ip_url", "has_legitimate_domain", "all_https",
               "max_domain_entropy", "has_suspicious_url_keywords"]
TEXT_COLS = [k for k, _ in D.SCORE_WEIGHTS[:10]]


def _cols(cols, fn=r6):
    return ", ".join(f"{fn(c)} AS {c}" for c in cols)


SQL["u1_url_extract"] = with_view(url_ctes() + "\nSELECT message_id, pos, url FROM url_rows")

SQL["u2_u11_url_features"] = with_view(
    url_ctes() + f"\nSELECT message_id, pos, url, dom AS netloc, upath AS path, {_cols(FEATURES)} FROM url_feats")

SQL["u12_message_url_rollup"] = with_view(
    rollup_ctes() + f"\nSELECT message_id, {_cols(ROLLUP_COLS)} FROM mu_roll")
SQL["u12_message_url_rollup_exploded"] = SQL["u12_message_url_rollup"]

SQL["u13_u14_url_analysis"] = with_view(
    rollup_ctes() + "\nSELECT message_id, n_urls AS num_urls, url_level AS risk_level, "
    "round(max_risk_score, 6) AS max_risk_score, suspicious_indicators FROM mu_roll")

_IND = [
    ("is_shortener <> 0", D.IND_SHORTENER), ("suspicious_tld <> 0", D.IND_TLD),
    ("is_ip_address <> 0", D.IND_IP), ("domain_entropy > 0.7", D.IND_RANDOM),
    ("has_suspicious_keywords <> 0", D.IND_KEYWORDS),
    ("is_legitimate_domain = 0 AND has_https = 0", D.IND_NO_HTTPS),
]
_IND_LIST = "[" + ", ".join(f"CASE WHEN {c} THEN '{s}' END" for c, s in _IND) + "]"

SQL["u13_url_indicators"] = with_view(
    url_ctes() + f"\nSELECT message_id, pos, url, round(url_risk_score, 6) AS risk_score, "
    f"array_to_string(list_filter({_IND_LIST}, lambda x: x IS NOT NULL), '; ') AS indicators FROM url_feats")

_NETLOC = ("SELECT dom AS netloc, count(*) AS n_urls, count(DISTINCT message_id) AS n_messages, "
           "count(DISTINCT sender) AS n_senders, round(avg(url_risk_score), 6) AS avg_risk, "
           "round(max(url_risk_score), 6) AS max_risk FROM url_feats GROUP BY dom")
SQL["u15_netloc_rollup"] = with_view(url_ctes() + "\n" + _NETLOC)
SQL["u15_indicator_rollup"] = with_view(
    url_ctes() + f""",
ind AS (SELECT message_id, url_risk_score, unnest(list_filter({_IND_LIST}, lambda x: x IS NOT NULL)) AS indicator
        FROM url_feats)
SELECT indicator, count(*) AS n_urls, count(DISTINCT message_id) AS n_messages,
  round(avg(url_risk_score), 6) AS avg_risk FROM ind GROUP BY indicator""")
SQL["u15_top_domains"] = with_view(
    url_ctes() + f", nr AS ({_NETLOC})\nSELECT * FROM nr ORDER BY n_messages DESC, netloc ASC LIMIT 20")

SQL["h1_text_features"] = with_view(
    scored_ctes() + f"\nSELECT message_id, {_cols(TEXT_COLS)} FROM scu")
SQL["h2_otp_gate"] = with_view(scored_ctes() + "\nSELECT message_id, otp, url_level FROM scu")
SQL["h3_h6_score"] = with_view(
    scored_ctes() + "\nSELECT message_id, round(spam_score, 6) AS spam_score, label, "
    "round(confidence, 6) AS confidence, risk_level, reasoning FROM scu")
SQL["h7_smishing_upgrade"] = with_view(
    scored_ctes() + "\nSELECT message_id, label, is_spam, is_smishing_up AS is_smishing FROM scu")
SQL["h8_batch_classify"] = with_view(
    scored_ctes() + """
SELECT message_id,
  CASE WHEN length(text) > 100 THEN concat(substr(text, 1, 100), '...') ELSE text END AS message,
  CASE WHEN text IS NOT NULL THEN is_spam END AS is_spam,
  CASE WHEN text IS NOT NULL THEN is_smishing_batch END AS is_smishing,
  CASE WHEN text IS NOT NULL THEN round(confidence, 6) END AS confidence,
  CASE WHEN text IS NOT NULL THEN label END AS spam_type,
  CASE WHEN text IS NOT NULL THEN risk_level END AS risk_level,
  CASE WHEN text IS NOT NULL THEN round(spam_score, 6) END AS spam_score,
  CASE WHEN text IS NOT NULL THEN reasoning END AS reasoning,
  CASE WHEN text IS NULL THEN 'message text is null' END AS error
FROM scu""")
SQL["h11_label_rollup"] = with_view(
    scored_ctes() + """,
rs AS (SELECT label, risk_level, spam_score, unnest(string_split(reasoning, ', ')) AS reason FROM scu)
SELECT label, risk_level, reason, count(*) AS n, round(avg(spam_score), 6) AS avg_score
FROM rs GROUP BY label, risk_level, reason""")


# ---------------------------------------------------------------- corpus
def _norm_src(source, dataset, quality, rank, raw):
    return (f"SELECT message_id, text AS message, lower({raw}) AS label, CAST(NULL AS VARCHAR) AS original_label, "
            f"false AS is_smishing, a2p_type, '{source}' AS source, '{dataset}' AS dataset, '{quality}' AS quality, "
            f"{rank} AS source_rank FROM m WHERE source = '{source}' AND lower({raw}) IN ('ham', 'spam')")


CORPUS_CTES = f"""
pg_raw AS (SELECT message_id, text AS message,
  lower(CASE WHEN is_smishing THEN 'smishing' ELSE true_label END) AS olab, a2p_type FROM m WHERE source = 'pages'),
pages_c AS (SELECT message_id, message, CASE WHEN olab IN ('spam', 'smishing', 'phishing') THEN 'spam' ELSE 'ham' END AS label,
  olab AS original_label, coalesce(olab IN ('smishing', 'phishing'), false) AS is_smishing, a2p_type,
  'pages' AS source, 'pages_sms' AS dataset, 'high' AS quality, 0 AS source_rank FROM pg_raw),
ev_c AS ({_norm_src('events', 'events_a2p', 'medium', 1, 'upper(true_label)')}),
or_c AS ({_norm_src('orders', 'orders_a2p', 'low', 2, 'true_label')}),
dc_c AS ({_norm_src('documents', 'documents_corpus', 'medium', 3, 'true_label')}),
cu AS (SELECT * FROM pages_c UNION ALL SELECT * FROM ev_c UNION ALL SELECT * FROM or_c UNION ALL SELECT * FROM dc_c),
cd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY
  CASE quality WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, source_rank, message_id) AS rn
  FROM cu) WHERE rn = 1),
cs AS (SELECT *, CASE WHEN r * 100 <= n * 70 THEN 'train' WHEN r * 100 <= n * 85 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', message)), message_id) AS r,
        count(*) OVER (PARTITION BY label) AS n FROM cd))"""

_CCOLS = "message_id, message, label, original_label, is_smishing, a2p_type, source, dataset, quality"
SQL["c1_c5_corpus_union"] = with_view(CORPUS_CTES + f"\nSELECT {_CCOLS} FROM cu")
SQL["c6_priority_dedup"] = with_view(CORPUS_CTES + f"\nSELECT {_CCOLS} FROM cd")
SQL["c7_stratified_split"] = with_view(CORPUS_CTES + "\nSELECT message_id, label, split FROM cs")
SQL["c7_split_leak_check"] = with_view(CORPUS_CTES + """
SELECT message FROM ((SELECT message FROM cs WHERE split = 'train') INTERSECT (SELECT message FROM cs WHERE split = 'val'))
UNION ALL SELECT message FROM ((SELECT message FROM cs WHERE split = 'train') INTERSECT (SELECT message FROM cs WHERE split = 'test'))
UNION ALL SELECT message FROM ((SELECT message FROM cs WHERE split = 'val') INTERSECT (SELECT message FROM cs WHERE split = 'test'))""")
SQL["c8_corpus_summary"] = with_view(CORPUS_CTES + """
SELECT label, source, a2p_type, split, CAST(grouping(label, source, a2p_type, split) AS BIGINT) AS gid, count(*) AS n,
  count(*) FILTER (WHERE label = 'spam') AS spam_count, count(*) FILTER (WHERE label = 'ham') AS ham_count,
  count(*) FILTER (WHERE is_smishing) AS smishing_count,
  round(CAST(count(*) FILTER (WHERE label = 'spam') AS DOUBLE) * 100.0 / count(*), 6) AS spam_pct,
  round(CAST(count(*) FILTER (WHERE label = 'ham') AS DOUBLE) * 100.0 / count(*), 6) AS ham_pct,
  round(CAST(count(*) FILTER (WHERE is_smishing) AS DOUBLE) * 100.0 / count(*), 6) AS smishing_pct
FROM cs GROUP BY GROUPING SETS ((), (label), (source), (a2p_type), (split, label))""")
SQL["c11_incremental_integrate"] = with_view(CORPUS_CTES + """,
ex AS (SELECT * FROM pages_c UNION ALL SELECT * FROM ev_c),
nw AS (SELECT * FROM ev_c UNION ALL SELECT * FROM or_c UNION ALL SELECT * FROM dc_c),
mg AS (SELECT * FROM ex UNION ALL SELECT * FROM nw WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.message = nw.message)),
mgd AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY
  CASE quality WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, source_rank, message_id) AS rn
  FROM mg) WHERE rn = 1)
SELECT message_id, label, source,
  CASE WHEN r * 100 <= n * 70 THEN 'train' WHEN r * 100 <= n * 85 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', message)), message_id) AS r,
      count(*) OVER (PARTITION BY label) AS n FROM mgd)""")
SQL["c12_retraining_set"] = with_view(CORPUS_CTES + """,
fb AS (SELECT d.text AS message, CASE WHEN l.toxic = 1 THEN 'spam' ELSE 'ham' END AS label, 0 AS prio,
  -CAST(1704067200 + d.doc_id AS DOUBLE) AS neg_ts FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
bo AS (SELECT message, label, 0 AS prio, neg_ts FROM fb UNION ALL SELECT message, label, 1, 0.0 FROM cd),
rk AS (SELECT *, row_number() OVER (PARTITION BY message ORDER BY prio, neg_ts, label) AS rn FROM bo)
SELECT sha256(message) AS message_sha, label, CASE WHEN prio = 0 THEN 'feedback' ELSE 'corpus' END AS origin
FROM rk WHERE rn = 1""")


# ---------------------------------------------------------------- evaluation, models
def _tst(split):
    cond = f"split = '{split}'" if isinstance(split, str) else "split IN (" + ", ".join(f"'{x}'" for x in split) + ")"
    return f"tst AS (SELECT message_id, message, message AS text, CAST(NULL AS VARCHAR) AS sender, label AS true_label, " \
           f"a2p_type, is_smishing, split FROM cs WHERE {cond})"


_H = "md5(message_id)"
PRED_SQL = f"""pred AS (
 SELECT message_id, 'rules' AS model, label, confidence, CAST(length(text) % 97 AS DOUBLE) / 10.0 AS latency_ms,
   CAST(NULL AS VARCHAR) AS error FROM scu
 UNION ALL SELECT message_id, 'hash_model',
   CASE WHEN substr({_H}, 3, 1) = 'f' THEN 'ham' WHEN substr({_H}, 1, 1) < '4' THEN 'spam' ELSE 'ham' END,
   CASE WHEN substr({_H}, 3, 1) = 'f' THEN 0.5 WHEN substr({_H}, 2, 1) < '8' THEN 0.9 ELSE 0.7 END,
   CASE WHEN substr({_H}, 3, 1) = 'f' THEN 0.0 ELSE CAST(length(message) % 389 AS DOUBLE) / 10.0 + 5.0 END,
   CASE WHEN substr({_H}, 3, 1) = 'f' THEN 'timeout' END FROM tst
 UNION ALL SELECT message_id, 'keyword_model',
   CASE WHEN contains(lower(message), 'free') OR contains(message, '$') THEN 'spam' ELSE 'ham' END,
   CASE WHEN contains(lower(message), 'free') OR contains(message, '$') THEN 0.8 ELSE 0.6 END,
   CAST(length(message) % 53 AS DOUBLE) / 10.0 + 1.0, CAST(NULL AS VARCHAR) FROM tst),
al AS (SELECT p.message_id, p.model, CASE WHEN p.label IN ('spam', 'smishing') THEN 'spam' ELSE p.label END AS pred,
  p.confidence, p.latency_ms, p.error, t.true_label, t.a2p_type, t.is_smishing, t.split
  FROM pred p JOIN tst t ON p.message_id = t.message_id)"""


def met_sql(src: str = "al") -> str:
    return MET_SQL.replace("FROM al GROUP BY model", f"FROM {src} GROUP BY model")


MET_SQL = f"""met0 AS (SELECT model, count(*) AS n,
  count(*) FILTER (WHERE true_label = 'spam' AND pred = 'spam') AS tp,
  count(*) FILTER (WHERE true_label = 'ham' AND pred = 'spam') AS fp,
  count(*) FILTER (WHERE true_label = 'ham' AND pred = 'ham') AS tn,
  count(*) FILTER (WHERE true_label = 'spam' AND pred = 'ham') AS fn,
  count(*) FILTER (WHERE pred = true_label) AS n_correct,
  count(*) FILTER (WHERE a2p_type IS NOT NULL) AS n_a2p,
  count(*) FILTER (WHERE a2p_type IS NOT NULL AND true_label = 'ham' AND pred = 'spam') AS a2p_fp,
  avg(latency_ms) AS latency_avg, quantile_cont(latency_ms, 0.5) AS latency_p50,
  quantile_cont(latency_ms, 0.95) AS latency_p95, quantile_cont(latency_ms, 0.99) AS latency_p99
  FROM al GROUP BY model),
met AS (SELECT model, n, tp, fp, tn, fn,
  coalesce(CAST(n_correct AS DOUBLE) / nullif(n, 0), 0.0) AS accuracy,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0.0) AS f1_score,
  coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0.0) AS fpr,
  CASE WHEN n_a2p > 0 THEN coalesce(CAST(a2p_fp AS DOUBLE) / nullif(n_a2p, 0), 0.0) END AS a2p_fpr,
  latency_avg, latency_p50, latency_p95, latency_p99 FROM met0),
metf AS (SELECT *, f1_score >= {D.TARGET_F1} AS meets_f1, coalesce(a2p_fpr < {D.TARGET_A2P_FPR}, true) AS meets_a2p_fpr,
  latency_p95 < {D.TARGET_P95_MS} AS meets_latency FROM met),
metr AS (SELECT *, meets_f1 AND meets_a2p_fpr AND meets_latency AS meets_all FROM metf)"""


def eval_sql(split: str, tail: str) -> str:
    return with_view(CORPUS_CTES + ",\n" + _tst(split) + "," + scored_ctes("tst") + ",\n" + PRED_SQL
                     + ",\n" + MET_SQL + "\n" + tail)


_MD = ["accuracy", "precision", "recall", "f1_score", "fpr", "a2p_fpr",
       "latency_avg", "latency_p50", "latency_p95", "latency_p99"]
SQL["e11_prediction_alignment"] = eval_sql("test", "SELECT message_id, model, pred, true_label, "
                                           "pred = true_label AS correct, round(confidence, 6) AS confidence FROM al")
SQL["e1_e6_model_metrics"] = eval_sql("test", f"""SELECT model, n, tp, fp, tn, fn, {_cols(_MD)},
  meets_f1, meets_a2p_fpr, meets_latency, meets_all FROM metr""")
SQL["e2_confusion_matrix"] = eval_sql("test", """SELECT model, true_label,
  count(*) FILTER (WHERE pred = 'ham') AS pred_ham, count(*) FILTER (WHERE pred = 'spam') AS pred_spam
  FROM al WHERE true_label IN ('ham', 'spam') GROUP BY model, true_label""")
SQL["e4_a2p_fpr_breakdown"] = eval_sql("test", """SELECT model, a2p_type, count(*) AS n,
  count(*) FILTER (WHERE true_label = 'ham' AND pred = 'spam') AS a2p_fp,
  round(coalesce(CAST(count(*) FILTER (WHERE true_label = 'ham' AND pred = 'spam') AS DOUBLE) / nullif(count(*), 0), 0.0), 6) AS a2p_fpr
  FROM al WHERE a2p_type IS NOT NULL GROUP BY ROLLUP (model, a2p_type) HAVING model IS NOT NULL""")
SQL["e7_leaderboard"] = eval_sql("test", """SELECT model, round(f1_score, 6) AS f1_score, round(a2p_fpr, 6) AS a2p_fpr,
  round(latency_p95, 6) AS latency_p95, meets_all, row_number() OVER (ORDER BY f1_score DESC, model ASC) AS rank FROM metr""")
SQL["e8_model_selection"] = eval_sql("test", """SELECT
  (SELECT model FROM metr WHERE meets_all ORDER BY f1_score DESC, model LIMIT 1) AS recommended,
  (SELECT model FROM metr ORDER BY f1_score DESC, model LIMIT 1) AS best_f1_model""")
SQL["e9_ensemble_candidates"] = eval_sql("val", """SELECT model, round(f1_score, 6) AS f1_score,
  round(f1_score / sum(f1_score) OVER (), 6) AS weight, count(*) OVER () >= 2 AS built FROM metr WHERE f1_score >= 0.9""")
SQL["e10_subset_metrics"] = eval_sql("test", """, x AS (SELECT *, unnest(list_filter(['all',
  CASE WHEN a2p_type IS NOT NULL THEN 'a2p' END, CASE WHEN is_smishing THEN 'smishing' END], lambda v: v IS NOT NULL)) AS subset FROM al)
SELECT model, subset, count(*) AS n,
  round(coalesce(CAST(count(*) FILTER (WHERE pred = true_label) AS DOUBLE) / nullif(count(*), 0), 0.0), 6) AS accuracy,
  round(coalesce(CAST(count(*) FILTER (WHERE true_label = 'spam' AND pred = 'spam') AS DOUBLE) / nullif(count(*) FILTER (WHERE pred = 'spam' AND true_label IN ('spam', 'ham')), 0), 0.0), 6) AS precision,
  round(coalesce(CAST(count(*) FILTER (WHERE true_label = 'spam' AND pred = 'spam') AS DOUBLE) / nullif(count(*) FILTER (WHERE true_label = 'spam' AND pred IN ('spam', 'ham')), 0), 0.0), 6) AS recall,
  round(coalesce(CAST(2 * count(*) FILTER (WHERE true_label = 'spam' AND pred = 'spam') AS DOUBLE) / nullif(2 * count(*) FILTER (WHERE true_label = 'spam' AND pred = 'spam') + count(*) FILTER (WHERE true_label = 'ham' AND pred = 'spam') + count(*) FILTER (WHERE true_label = 'spam' AND pred = 'ham'), 0), 0.0), 6) AS f1_score
FROM x GROUP BY model, subset""")

_FEEDBACK = """fd AS (SELECT concat('dc', CAST(d.doc_id AS VARCHAR)) AS message_id, CAST(NULL AS VARCHAR) AS sender, d.text,
  CASE WHEN l.toxic = 1 THEN 'spam' ELSE 'ham' END AS true_label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),"""
SQL["e12_feedback_agreement"] = with_view(_FEEDBACK + scored_ctes("fd") + """,
fb AS (SELECT CASE WHEN label IN ('spam', 'smishing') THEN 'spam' ELSE label END AS predicted_label, true_label FROM scu)
SELECT predicted_label, true_label,
  CASE WHEN predicted_label = 'spam' AND true_label = 'ham' THEN 'false_positive'
       WHEN predicted_label = 'ham' AND true_label = 'spam' THEN 'false_negative' ELSE 'correct' END AS feedback_type,
  count(*) AS n FROM fb GROUP BY ALL""")

SQL["m2_url_model_vote"] = with_view(url_ctes() + """,
va AS (SELECT message_id, count(*) FILTER (WHERE url_risk_score > 0.5) AS n_phish,
  max(CASE WHEN url_risk_score > 0.5 THEN url_risk_score END) AS max_conf FROM url_feats GROUP BY message_id)
SELECT m.message_id, CASE WHEN va.n_phish > 0 THEN 'spam' ELSE 'ham' END AS label,
  round(CASE WHEN va.n_phish > 0 THEN va.max_conf WHEN va.n_phish IS NOT NULL THEN 0.7 ELSE 0.5 END, 6) AS confidence
FROM m LEFT JOIN va ON m.message_id = va.message_id""")
SQL["m4_voting_ensemble"] = eval_sql("test", """SELECT message_id,
  CASE WHEN sum(CASE WHEN label IN ('spam', 'smishing') THEN 1 ELSE 0 END) > count(*) / 2 THEN 'spam' ELSE 'ham' END AS label,
  round(sum(CASE WHEN label IN ('spam', 'smishing') THEN 1 ELSE 0 END) / count(*), 6) AS confidence
FROM pred GROUP BY message_id""")
SQL["m5_weighted_ensemble"] = with_view(
    CORPUS_CTES + ",\n" + _tst(("val", "test")) + "," + scored_ctes("tst") + ",\n" + PRED_SQL
    + ",\nalv AS (SELECT * FROM al WHERE split = 'val'),\n" + met_sql("alv") + """,
wv AS (SELECT model, f1_score / sum(f1_score) OVER () AS w FROM metr WHERE f1_score >= 0.9 AND (SELECT count(*) FROM metr WHERE f1_score >= 0.9) >= 2),
ws AS (SELECT p.message_id, sum(CASE WHEN p.label IN ('spam', 'smishing') THEN p.confidence * wv.w ELSE 0.0 END) AS score
  FROM pred p JOIN tst t ON p.message_id = t.message_id JOIN wv ON p.model = wv.model
  WHERE t.split = 'test' GROUP BY p.message_id)
SELECT message_id, CASE WHEN score > 0.5 THEN 'spam' ELSE 'ham' END AS label,
  round(CASE WHEN score > 0.5 THEN score ELSE 1.0 - score END, 6) AS confidence FROM ws""")
_ROUTE = """, rt AS (
  SELECT message_id, label, confidence, 'fast_model' AS routed_to, risk_level, reasoning FROM scu WHERE confidence >= 0.85
  UNION ALL SELECT message_id,
    CASE WHEN contains(lower(message), 'free') OR contains(message, '$') THEN 'spam' ELSE 'ham' END,
    CASE WHEN contains(lower(message), 'free') OR contains(message, '$') THEN 0.8 ELSE 0.6 END, 'slow_model', NULL, NULL
  FROM scu WHERE NOT (confidence >= 0.85))"""
SQL["m6_confidence_router"] = eval_sql("test", _ROUTE + "\nSELECT message_id, label, round(confidence, 6) AS confidence, routed_to, risk_level, reasoning FROM rt")
SQL["m7_routing_stats"] = eval_sql("test", _ROUTE + """
SELECT count(*) FILTER (WHERE routed_to = 'fast_model') AS fast_count, count(*) FILTER (WHERE routed_to = 'slow_model') AS slow_count,
  round(coalesce(count(*) FILTER (WHERE routed_to = 'fast_model') * 100.0 / nullif(count(*), 0), 0.0), 6) AS fast_percentage FROM rt""")


# ---------------------------------------------------------------- traffic, spend, streams
from ..functions import text as _T  # noqa: E402


def sql_text(s: str) -> str:
    """A SQL string literal for ``s`` with real newlines (chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join(q(p) for p in parts) if len(parts) > 1 else q(s)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {q(_T.STRIP_PATTERN)}, '', 'g')"


def _forward(body: str) -> str:
    t = _strip(body)
    whens = " ".join(f"WHEN starts_with(lower({t}), {q(p)}) THEN {_strip(f'substr({t}, {len(p) + 1})')}"
                     for p in D.FORWARD_PREFIXES)
    return f"(CASE {whens} ELSE {t} END)"


_EVENT_TEXT = """CASE e.event_id % 4 WHEN 0 THEN concat(cast(100000 + e.event_id AS string), ' is your Google security code')
   WHEN 1 THEN concat('Nike: ', cast(20 + e.event_id % 4 * 10 AS string), '% off! Shop now. Reply STOP to unsubscribe')
   WHEN 2 THEN 'Appointment reminder: Dentist tomorrow at 2pm' ELSE concat('Hey, are we still meeting at ', cast(e.event_id % 12 AS string), 'pm?') END"""

TRAFFIC_CTES = f"""
pgn AS (SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT page_id FROM pages WHERE page_id IS NOT NULL)),
evn AS (SELECT event_id, dense_rank() OVER (ORDER BY event_id) - 1 AS place FROM events WHERE event_id % 4 = 0),
car AS (SELECT DISTINCT evn.event_id, concat('pg', CAST(pgn.page_id AS VARCHAR)) AS mid FROM evn JOIN pgn ON evn.place % pgn.n = pgn.place),
tr0 AS (SELECT e.event_id, CAST(e.ts AS TIMESTAMP) AS ts, concat('+1555', CAST(2000000 + e.user_id AS VARCHAR)) AS sender,
  coalesce(pm.text, {_EVENT_TEXT}) AS body, e.event_type, e.value AS latency_ms, e.event_type = 'error' AS is_error,
  e.event_type <> 'view' AS via_sms, CAST(e.ts AS DATE) AS date
  FROM events e LEFT JOIN car ON e.event_id = car.event_id LEFT JOIN m pm ON pm.message_id = car.mid),
tr AS (SELECT *, event_id AS message_id, {_forward('body')} AS text FROM tr0),
g AS (SELECT *, CAST({D.COST_PER_MESSAGE} AS DECIMAL(12,4)) AS cost,
  (row_number() OVER (PARTITION BY date ORDER BY ts, event_id) - 1) * CAST({D.COST_PER_MESSAGE} AS DECIMAL(12,4)) AS asked FROM tr0 WHERE via_sms),
gt0 AS (SELECT *, asked < {LIMIT} AS accepted,
  asked < {LIMIT} AND asked + cost >= {LIMIT} AS alert FROM g),
gt AS (SELECT *, CASE WHEN accepted THEN asked ELSE sum(cost) FILTER (WHERE accepted) OVER (PARTITION BY date) END AS spend_before FROM gt0),
led AS (SELECT date, sum(cost) AS daily_spend, count(*) AS message_count FROM gt WHERE accepted GROUP BY date)"""

TS = "'%Y-%m-%d %H:%M:%S.%f'"


def traffic_sql(tail: str, scored: bool = False, recursive: bool = False) -> str:
    body = TRAFFIC_CTES + ("," + scored_ctes("tr") + """,
hist AS (SELECT event_id, ts AS timestamp, date, label AS classification, is_smishing_up AS is_smishing, confidence,
  via_sms, length(text) AS message_length, sha256(concat('msgscreen', sender)) AS from_number_hash FROM scu
  WHERE NOT is_error AND (NOT via_sms OR event_id IN (SELECT event_id FROM gt WHERE accepted))),
dc AS (SELECT date, count(*) AS total_messages,
  count(*) FILTER (WHERE classification IN ('spam', 'smishing') OR is_smishing) AS spam_count,
  count(*) FILTER (WHERE (classification IN ('spam', 'smishing') OR is_smishing) AND is_smishing) AS smishing_count,
  count(*) FILTER (WHERE NOT (classification IN ('spam', 'smishing') OR is_smishing)) AS ham_count,
  count(*) FILTER (WHERE via_sms) AS sms_received FROM hist GROUP BY date),
dcr AS (SELECT *, round(coalesce(CAST(spam_count AS DOUBLE) / nullif(total_messages, 0), 0.0), 6) AS spam_rate,
  round(coalesce(CAST(smishing_count AS DOUBLE) / nullif(spam_count, 0), 0.0), 6) AS smishing_rate FROM dc)"""
                            if scored else "")
    sql = with_view(body + "\n" + tail)
    return sql.replace("WITH", "WITH RECURSIVE", 1) if recursive else sql


SQL["h9_forward_strip"] = traffic_sql("SELECT event_id, body, text AS message FROM tr")
_PCT = "CAST(CAST(round_even(confidence * 100.0, 0) AS BIGINT) AS VARCHAR)"
_WARN = ("list_filter([CASE WHEN contains(lower(reasoning), 'urgent') OR contains(lower(reasoning), 'immediate') "
         f"THEN {q(D.REPLY_WARN_URGENT)} END, CASE WHEN contains(lower(reasoning), 'prize') OR "
         f"contains(lower(reasoning), 'winner') THEN {q(D.REPLY_WARN_PRIZE)} END, CASE WHEN contains(lower(reasoning), "
         f"'account') AND contains(lower(reasoning), 'verify') THEN {q(D.REPLY_WARN_VERIFY)} END, CASE WHEN "
         f"contains(lower(reasoning), 'credential') THEN {q(D.REPLY_WARN_CREDENTIAL)} END], lambda x: x IS NOT NULL)[1:4]")
SQL["h10_reply_outbox"] = traffic_sql(f""", gs AS (SELECT *, CAST({D.COST_PER_MESSAGE} AS DECIMAL(12,4)) AS cost,
  coalesce(sum(CAST({D.COST_PER_MESSAGE} AS DECIMAL(12,4))) OVER (PARTITION BY date ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spend_before, {_WARN} AS warns FROM scu WHERE via_sms)
SELECT event_id, sender,
  CASE WHEN NOT (spend_before < {LIMIT}) THEN {q(D.REPLY_LIMIT)} WHEN is_error THEN {q(D.REPLY_ERROR)}
       WHEN is_spam THEN concat(CASE WHEN is_smishing_up THEN {q(D.REPLY_SMISHING_TITLE)} ELSE {q(D.REPLY_SPAM_TITLE)} END,
         chr(10), 'Confidence: ', {_PCT}, '%', chr(10), 'Risk: ', upper(risk_level), chr(10), chr(10),
         CASE WHEN len(warns) > 0 THEN concat(array_to_string(warns, chr(10)), chr(10)) ELSE '' END,
         CASE WHEN is_smishing_up THEN {sql_text(D.REPLY_SMISHING_ADVICE)} ELSE {sql_text(D.REPLY_SPAM_ADVICE)} END)
       ELSE concat({q(D.REPLY_SAFE_ICON + ' SAFE (')}, {_PCT}, '% confidence)', chr(10), chr(10), {q(D.REPLY_SAFE_BODY)}) END AS reply,
  CASE WHEN is_error OR NOT (spend_before < {LIMIT}) THEN NULL
       WHEN NOT is_spam THEN concat({q(D.REPLY_SAFE_ICON + ' SAFE (')}, {_PCT}, '%)')
       WHEN is_smishing_up THEN concat('\U0001F6A8 SMISHING! (', {_PCT}, '%) - DO NOT CLICK LINKS OR REPLY')
       ELSE concat('⚠️ SPAM (', {_PCT}, '%) - Recommend deleting') END AS short_reply
FROM gs""", scored=True)

_HIST = "SELECT event_id, strftime(timestamp, " + TS + ") AS timestamp, date, classification, is_smishing, " \
        "round(confidence, 6) AS confidence, via_sms, message_length, from_number_hash FROM hist"
SQL["t1_privacy_projection"] = traffic_sql(_HIST, scored=True)
SQL["t2_t3_daily_counters"] = traffic_sql("SELECT * FROM dcr", scored=True)
SQL["t4_last_days"] = traffic_sql("SELECT * FROM dcr ORDER BY date DESC LIMIT 7", scored=True)
SQL["t5_last_messages"] = traffic_sql(_HIST + " ORDER BY hist.timestamp DESC, event_id DESC LIMIT 100", scored=True)
SQL["t6_spend_ledger"] = traffic_sql("SELECT date, CAST(daily_spend AS DECIMAL(18,4)) AS daily_spend, message_count FROM led")
SQL["t7_spend_gate"] = traffic_sql("SELECT event_id, date, CAST(spend_before AS DECIMAL(18,4)) AS spend_before, "
                                   "accepted, alert FROM gt")
SQL["t8_spend_alerts"] = traffic_sql("SELECT event_id, date, strftime(ts, " + TS + ") AS ts, "
                                     "CAST(spend_before AS DECIMAL(18,4)) AS spend_before FROM gt WHERE alert")
SQL["t9_budget_status"] = traffic_sql(f"""SELECT date, CAST(daily_spend AS DECIMAL(18,4)) AS daily_spend, message_count,
  daily_spend < {LIMIT} AS enabled,
  CAST(greatest(CAST(0 AS DECIMAL(12,4)), CAST({LIMIT} AS DECIMAL(12,4)) - daily_spend) AS DECIMAL(18,4)) AS remaining_budget,
  CASE WHEN daily_spend / CAST({LIMIT} AS DECIMAL(12,4)) >= {D.BUDGET_CRITICAL_SHARE} THEN 'critical'
       WHEN daily_spend / CAST({LIMIT} AS DECIMAL(12,4)) >= {D.BUDGET_WARNING_SHARE} THEN 'warning'
       ELSE 'normal' END AS band FROM led""")
# the service as a state machine: each day's overrides and messages one after the other
SQL["t10_manual_override"] = traffic_sql(f""", ov AS (SELECT event_id, CAST(ts AS DATE) AS date, CAST(ts AS TIMESTAMP) AS ts,
    CASE WHEN event_type = 'signup' THEN 'disable' ELSE 'enable' END AS action FROM events
    WHERE (event_type = 'signup' AND user_id % 50 = 0) OR (event_type = 'purchase' AND user_id % 50 = 1)),
tl AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY ts, kind, event_id) AS rn FROM (
  SELECT date, ts, 0 AS kind, event_id, action FROM ov UNION ALL SELECT date, ts, 1, event_id, NULL FROM tr0 WHERE via_sms)),
st AS (SELECT date, rn, kind, event_id, action AS override, action IS NOT DISTINCT FROM 'disable' AS disabled, false AS alerted, false AS alert, false AS served,
    CAST(0 AS DECIMAL(12,4)) AS spend, CAST(0 AS DECIMAL(12,4)) AS spend_before FROM (SELECT date, 0 AS rn, 0 AS kind, 0 AS event_id, CAST(NULL AS VARCHAR) AS action FROM tl GROUP BY date)
  UNION ALL
  SELECT t.date, t.rn, t.kind, t.event_id, coalesce(t.action, s.override),
    CASE WHEN t.kind = 0 THEN t.action = 'disable' WHEN s.disabled THEN true
         ELSE s.spend + {D.COST_PER_MESSAGE} >= {LIMIT} AND NOT s.alerted END,
    s.alerted OR (t.kind = 1 AND NOT s.disabled AND s.spend + {D.COST_PER_MESSAGE} >= {LIMIT}),
    t.kind = 1 AND NOT s.disabled AND NOT s.alerted AND s.spend + {D.COST_PER_MESSAGE} >= {LIMIT},
    t.kind = 1 AND NOT s.disabled,
    CAST(s.spend + CASE WHEN t.kind = 1 AND NOT s.disabled THEN {D.COST_PER_MESSAGE} ELSE 0 END AS DECIMAL(12,4)), s.spend
  FROM st s JOIN tl t ON t.date = s.date AND t.rn = s.rn + 1)
SELECT event_id, date, override, served AS service_enabled, alert, CAST(spend_before AS DECIMAL(18,4)) AS spend_before FROM st WHERE kind = 1""",
                                         recursive=True)
SQL["t11_provider_reconciliation"] = traffic_sql("""SELECT coalesce(led.date, p.date) AS date,
  CAST(led.daily_spend AS DECIMAL(18,4)) AS daily_spend, led.message_count, p.provider_count,
  CAST(p.provider_cost AS DECIMAL(18,4)) AS provider_cost,
  CAST(coalesce(p.provider_cost, 0) - coalesce(led.daily_spend, 0) AS DECIMAL(18,4)) AS cost_delta,
  coalesce(p.provider_count, 0) - coalesce(led.message_count, 0) AS count_delta
FROM led FULL OUTER JOIN (SELECT CAST(ts AS DATE) AS date, count(*) AS provider_count,
    sum(abs(CAST(CASE WHEN event_id % 10 = 0 THEN NULL ELSE concat('-', CAST(value AS VARCHAR)) END AS DECIMAL(12,4)))) AS provider_cost
    FROM events WHERE event_type = 'purchase' GROUP BY 1) p ON led.date = p.date""")
SQL["t12_dashboard_series"] = traffic_sql("""SELECT strftime(bucket_start, """ + TS + """) AS bucket_start, total, spam, smishing, ham, sample
FROM (SELECT *, row_number() OVER (ORDER BY bucket_start DESC) AS sample FROM (
  SELECT time_bucket(INTERVAL '1 hour', timestamp) AS bucket_start, count(*) AS total,
    count(*) FILTER (WHERE classification IN ('spam', 'smishing') OR is_smishing) AS spam,
    count(*) FILTER (WHERE (classification IN ('spam', 'smishing') OR is_smishing) AND is_smishing) AS smishing,
    count(*) FILTER (WHERE NOT (classification IN ('spam', 'smishing') OR is_smishing)) AS ham
  FROM hist GROUP BY 1)) WHERE sample <= 10""", scored=True)
SQL["t13_cost_projection"] = traffic_sql(f"""SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(message_count) AS messages,
  CAST(CAST({D.MONTHLY_NUMBER_COST} AS DECIMAL(12,4)) + CAST({D.COST_PER_MESSAGE} AS DECIMAL(12,4)) * sum(message_count) AS DECIMAL(18,4)) AS projected_cost
FROM led GROUP BY 1""")
SQL["x4_feedback_triggers"] = with_view("""fl AS (SELECT doc_id AS feedback_id, make_timestamp(CAST((1704067200 + doc_id * 37) AS BIGINT) * 1000000) AS ts FROM labels),
fr AS (SELECT *, (row_number() OVER (ORDER BY ts, feedback_id) - 1) // 100 AS batch FROM fl)
SELECT batch, strftime(min(ts), """ + TS + """) AS first_ts, strftime(max(ts), """ + TS + """) AS trigger_ts
FROM fr GROUP BY batch HAVING count(*) = 100""")


def _x6_sql(width_min: int, slide_min: int | None) -> str:
    if slide_min is None:
        src = "SELECT time_bucket(INTERVAL '1 minute', ts) AS ws, * FROM scu"
        width = 60
    else:
        n = width_min // slide_min
        src = (f"SELECT time_bucket(INTERVAL '{slide_min} minute', ts) - to_minutes(i * {slide_min}) AS ws, * "
               f"FROM scu, range({n}) r(i)")
        width = width_min * 60
    return f""", xw AS ({src})
SELECT strftime(ws, {TS}) AS window_start, strftime(ws + to_seconds({width}), {TS}) AS window_end, count(*) AS requests,
  round(count(*) / {float(width)}, 6) AS rate_per_s,
  round(CAST(count(*) FILTER (WHERE is_error) AS DOUBLE) / count(*), 6) AS error_rate,
  round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95,
  round(quantile_cont(latency_ms, 0.99), 6) AS p99,
  count(*) FILTER (WHERE label = 'ham' AND NOT is_error) AS ham, count(*) FILTER (WHERE label = 'spam' AND NOT is_error) AS spam,
  count(*) FILTER (WHERE label = 'smishing' AND NOT is_error) AS smishing
FROM xw GROUP BY ws"""


SQL["x6_traffic_metrics"] = traffic_sql(_x6_sql(1, None), scored=True)
SQL["x6_traffic_metrics_sliding"] = traffic_sql(_x6_sql(5, 1), scored=True)
SQL["x7_sender_rate_limit"] = traffic_sql(f"""SELECT event_id, sender,
  count(*) OVER (PARTITION BY sender ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS recent,
  count(*) OVER (PARTITION BY sender ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) > 1 AS throttled
FROM tr0""")
SQL["x8_volume_spikes"] = traffic_sql(f""", hb AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket_start, count(*) AS requests,
  count(*) FILTER (WHERE is_error) AS errors FROM tr0 GROUP BY 1),
hs AS (SELECT unnest(generate_series(min(bucket_start), max(bucket_start), INTERVAL '1 hour')) AS bucket_start FROM hb),
hm AS (SELECT bucket_start, requests, errors, avg(coalesce(requests, 0)) OVER (ORDER BY bucket_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS trailing_mean
  FROM hs LEFT JOIN hb USING (bucket_start))
SELECT strftime(bucket_start, {TS}) AS bucket_start, requests, errors, round(trailing_mean, 6) AS trailing_mean,
  round(CAST(errors AS DOUBLE) / requests, 6) AS error_rate, requests > trailing_mean * 1.5 AS spike,
  CAST(errors AS DOUBLE) / requests > {D.ERROR_RATE_ALERT} AS high_errors FROM hm WHERE requests IS NOT NULL""")


# ---------------------------------------------------------------- monitoring
_DF = ["spam_score", "caps_ratio", "exclamation_score", "number_score", "max_url_risk", "num_urls"]
_DRIFT = """, dl AS (SELECT CASE WHEN dayofmonth(ts) <= 15 THEN 'baseline' ELSE 'current' END AS period, feature, value FROM scu
  UNPIVOT (value FOR feature IN (""" + ", ".join(_DF) + """))),
dh AS (SELECT feature, period, CAST(least(floor(value * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM dl GROUP BY ALL),
ds AS (SELECT *, n / sum(n) OVER (PARTITION BY feature, period) AS share FROM dh),
dj AS (SELECT coalesce(p.feature, q.feature) AS feature, greatest(coalesce(p.share, 0.0), 1e-6) AS pp,
  greatest(coalesce(q.share, 0.0), 1e-6) AS qq
  FROM (SELECT * FROM ds WHERE period = 'baseline') p FULL OUTER JOIN (SELECT * FROM ds WHERE period = 'current') q
  ON p.feature = q.feature AND p.bin = q.bin),
psi AS (SELECT feature, sum((qq - pp) * ln(qq / pp)) AS psi FROM dj GROUP BY feature)"""
SQL["d1_feature_drift"] = traffic_sql(_DRIFT + f"\nSELECT feature, round(psi, 6) AS psi, psi > {D.DRIFT_ALERT} AS drift_alert FROM psi",
                                      scored=True)
SQL["d2_prediction_drift"] = traffic_sql(""", pd AS (SELECT date, count(*) AS n,
  count(*) FILTER (WHERE classification IN ('spam', 'smishing')) AS spam FROM hist GROUP BY date)
SELECT date, n, spam, round(spam / n, 6) AS spam_share, round(sum(spam) OVER () / sum(n) OVER (), 6) AS baseline_share,
  round(spam / n - sum(spam) OVER () / sum(n) OVER (), 6) AS share_delta FROM pd""", scored=True)
SQL["d3_performance_drift"] = with_view(_FEEDBACK.replace("AS true_label FROM", "AS true_label, d.doc_id FROM") + scored_ctes("fd") + """,
pf AS (SELECT CAST(make_timestamp(CAST((1704067200 + doc_id * 3600) AS BIGINT) * 1000000) AS DATE) AS date,
  CASE WHEN label IN ('spam', 'smishing') THEN 'spam' ELSE label END = true_label AS ok FROM scu),
pg2 AS (SELECT date, count(*) AS n, count(*) FILTER (WHERE ok) AS correct, count(*) FILTER (WHERE ok) / count(*) AS accuracy FROM pf GROUP BY date)
SELECT date, n, correct, round(accuracy, 6) AS accuracy, round(accuracy - lag(accuracy) OVER (ORDER BY date), 6) AS accuracy_change FROM pg2""")

import re as _re  # noqa: E402

_SCORED_NAMES = ["mu", "url_rows", "url_parts", "url_f0", "url_f1", "url_feats", "url_agg", "mu_roll",
                 "tfe", "s0", "sc", "scu"]


def suffixed(sql: str, suf: str, names=_SCORED_NAMES) -> str:
    """Rename the scorer's CTEs so two scored inputs can share one WITH."""
    return _re.sub(r"\b(" + "|".join(names) + r")\b", lambda m_: m_.group(1) + suf, sql)


SQL["d4_alert_rules"] = with_view(
    CORPUS_CTES + ",\n" + _tst("test") + "," + scored_ctes("tst") + ",\n" + PRED_SQL + ",\n" + MET_SQL + ","
    + TRAFFIC_CTES + "," + suffixed(scored_ctes("tr"), "_t") + suffixed(_DRIFT, "_t") + f""",
rules AS (SELECT * FROM (VALUES ('a2p_fpr', '>', {D.TARGET_A2P_FPR}), ('latency_p95', '>', {D.TARGET_P95_MS}),
  ('psi', '>', {D.DRIFT_ALERT}), ('error_rate', '>', {D.ERROR_RATE_ALERT})) v(metric, op, threshold)),
vals AS (
  SELECT 'a2p_fpr' AS metric, model AS subject, a2p_fpr AS value FROM metr
  UNION ALL SELECT 'latency_p95', model, latency_p95 FROM metr
  UNION ALL SELECT 'error_rate', strftime(time_bucket(INTERVAL '1 hour', ts), {TS}),
    CAST(count(*) FILTER (WHERE is_error) AS DOUBLE) / count(*) FROM scu_t GROUP BY time_bucket(INTERVAL '1 hour', ts)
  UNION ALL SELECT 'psi', feature, psi FROM psi)
SELECT v.metric, v.subject, round(v.value, 6) AS value, r.threshold FROM vals v JOIN rules r ON v.metric = r.metric
WHERE CASE WHEN r.op = '>' THEN v.value > r.threshold ELSE v.value < r.threshold END""")


# ---------------------------------------------------------------- generators, model scoring, sinks
def _arr(vals):
    return "[" + ", ".join(q(str(v)) for v in vals) + "]"


def _fill_sql(templates, fields):
    t = "template"
    for k, v in fields.items():
        t = f"replace({t}, '{{{k}}}', {v})"
    return t


def _c9_sql():
    from ..operators import corpus as CO
    pick = lambda vals, idx: f"{_arr(vals)}[CAST(({idx}) % {len(vals)} AS BIGINT) + 1]"
    otp = _fill_sql(CO.OTP_TEMPLATES, {"service": "service",
                                        "code": "substr(CAST(100000 + (i * 13) % 900000 AS VARCHAR), 1, 6)"})
    trans = _fill_sql(CO.TRANS_TEMPLATES, {"service": pick(CO.TRANS_SERVICES, "i"), "order": "CAST(10000 + i AS VARCHAR)",
                                           "amount": "concat(CAST(10 + i % 90 AS VARCHAR), '.00')",
                                           "person": pick(CO.TRANS_PEOPLE, "i"), "date": pick(CO.TRANS_DATES, "i")})
    mkt = _fill_sql(CO.MARKETING_TEMPLATES, {"brand": pick(CO.MARKETING_BRANDS, "i"),
                                             "percent": pick(CO.MARKETING_PERCENTS, "i"),
                                             "points": "CAST(100 + i * 10 AS VARCHAR)"})
    alert = _fill_sql(CO.ALERT_TEMPLATES, {"service": pick(CO.ALERT_SERVICES, "i"), "time": pick(CO.ALERT_TIMES, "i"),
                                           "condition": pick(CO.ALERT_CONDITIONS, "i"),
                                           "amount": pick(CO.ALERT_AMOUNTS, "i"), "date": pick(CO.ALERT_DATES, "i")})
    fams = [("2fa", otp, CO.OTP_TEMPLATES), ("transactional", trans, CO.TRANS_TEMPLATES), ("marketing", mkt, CO.MARKETING_TEMPLATES),
            ("alerts", alert, CO.ALERT_TEMPLATES)]
    parts = [f"SELECT i, {v} AS message, 'ham' AS label, 'a2p_synthetic' AS source, 'a2p_{k}' AS dataset, "
             f"'high' AS quality, '{k}' AS a2p_type, false AS is_smishing FROM (SELECT event_id AS i FROM events) "
             f"CROSS JOIN (SELECT unnest({_arr(ts)}) AS template) CROSS JOIN (SELECT unnest({_arr(CO.OTP_SERVICES if k == '2fa' else [''])}) AS service)"
             for k, v, ts in fams]
    return "\nUNION ALL\n".join(parts)


SQL["c9_a2p_generator"] = _c9_sql()
SQL["m1_model_scoring"] = eval_sql("test", """SELECT message_id, 'keyword_model' AS model,
  CASE WHEN contains(lower(message), 'free') OR contains(message, '$') THEN 'spam' ELSE 'ham' END AS label,
  CASE WHEN contains(lower(message), 'free') OR contains(message, '$') THEN 0.8 ELSE 0.6 END AS confidence,
  CAST(NULL AS VARCHAR) AS error FROM tst""")
SQL["s4_s8_history_roundtrip"] = traffic_sql("SELECT strftime(timestamp, " + TS + ") AS timestamp, date, classification, "
                                             "is_smishing, round(confidence, 6) AS confidence, via_sms, message_length, "
                                             "from_number_hash FROM hist", scored=True)

SQL["s5_feedback_roundtrip"] = with_view(_FEEDBACK.replace("AS true_label FROM", "AS true_label, d.doc_id FROM") + scored_ctes("fd") + """
SELECT concat('doc ', CAST(doc_id AS VARCHAR)) AS message, label AS predicted_label, true_label,
  CASE WHEN CASE WHEN label IN ('spam', 'smishing') THEN 'spam' ELSE label END = 'spam' AND true_label = 'ham' THEN 'false_positive'
       WHEN CASE WHEN label IN ('spam', 'smishing') THEN 'spam' ELSE label END = 'ham' AND true_label = 'spam' THEN 'false_negative'
       ELSE 'correct' END AS feedback_type, CAST(NULL AS VARCHAR) AS notes,
  strftime(make_timestamp(CAST((1704067200 + doc_id * 37) AS BIGINT) * 1000000), """ + TS + """) AS timestamp FROM scu""")
SQL["s6_split_sink"] = f"SELECT *, count(*) OVER (PARTITION BY split) AS split_size FROM ({SQL['c7_stratified_split']})"
SQL["s7_evaluation_store"] = f"SELECT *, row_number() OVER (ORDER BY f1_score DESC, model) = 1 AS best_f1 FROM ({SQL['e1_e6_model_metrics']})"


def _c10_sql():
    from ..operators import corpus as CO

    def pick(vals, idx="i"):
        return f"{_arr(vals)}[CAST(({idx}) % {len(vals)} AS BIGINT) + 1]"

    def fill(templates, fields):
        t = "template"
        for k, v in fields.items():
            t = f"replace({t}, '{{{k}}}', {v})"
        return t
    spam = fill(CO.SPAM_TEMPLATES, {"prize": pick(CO.SPAM_PRIZES), "url": "concat('www.claim-prize', CAST(i AS VARCHAR), '.com')",
                                    "number": "concat('8', printf('%04d', i))", "amount": pick(CO.SPAM_AMOUNTS),
                                    "service": pick(CO.SPAM_SERVICES), "days": pick(CO.SPAM_DAYS)})
    smish = fill(CO.SMISHING_TEMPLATES, {"bank": pick(CO.SMISHING_BANKS), "action": pick(CO.SMISHING_ACTIONS),
                                         "url": "concat('secure-verify', CAST(i AS VARCHAR), '.xyz/login')",
                                         "location": pick(CO.SMISHING_LOCATIONS), "service": pick(CO.SMISHING_SERVICES),
                                         "threat": pick(CO.SMISHING_THREATS), "amount": pick(CO.SMISHING_AMOUNTS),
                                         "person": pick(CO.SMISHING_PEOPLE)})
    ham = fill(CO.HAM_TEMPLATES, {"activity": pick(CO.HAM_ACTIVITIES), "time": pick(CO.HAM_TIMES), "item": pick(CO.HAM_ITEMS),
                                  "task": pick(CO.HAM_TASKS), "praise": pick(CO.HAM_PRAISES), "when": pick(CO.HAM_WHENS),
                                  "place": pick(CO.HAM_PLACES),
                                  "items": f"concat({pick(CO.HAM_ITEMS)}, ', ', {pick(CO.HAM_ITEMS, 'i + 1')})",
                                  "appointment": pick(CO.HAM_APPOINTMENTS), "date": pick(CO.HAM_DATES),
                                  "name": pick(CO.HAM_NAMES), "action": pick(CO.HAM_ACTIONS),
                                  "duration": pick(CO.HAM_DURATIONS)})
    parts = [f"SELECT i, {v} AS message, '{lab}' AS label, 'fallback_expanded' AS source, 'fallback' AS dataset, "
             f"'medium' AS quality, {smi} AS is_smishing FROM (SELECT o_orderkey AS i FROM orders) CROSS JOIN (SELECT unnest({_arr(ts)}) AS template)"
             for v, lab, smi, ts in ((spam, "spam", "false", CO.SPAM_TEMPLATES), (smish, "spam", "true", CO.SMISHING_TEMPLATES), (ham, "ham", "false", CO.HAM_TEMPLATES))]
    return "\nUNION ALL\n".join(parts)


SQL["c10_threat_generator"] = _c10_sql()

SQL["x8_sender_sessions"] = traffic_sql(""", ss AS (SELECT sender, ts, event_id,
  CASE WHEN lag(ts) OVER (PARTITION BY sender ORDER BY ts, event_id) IS NULL
         OR epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY sender ORDER BY ts, event_id)) > 1800000000
       THEN 1 ELSE 0 END AS st FROM tr0),
sn AS (SELECT *, sum(st) OVER (PARTITION BY sender ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM ss)
SELECT sender, session, count(*) AS messages, strftime(min(ts), """ + TS + """) AS session_start,
  strftime(max(ts), """ + TS + """) AS session_end, count(*) > 1 AS unusual FROM sn GROUP BY sender, session""")


# ---------------------------------------------------------------- streams and delimited sources
_BAD = "(is_error OR event_id % 13 = 0)"
_CLS = f"CASE WHEN NOT {_BAD} THEN label END"
_SPAM = f"NOT {_BAD} AND (label IN ('spam', 'smishing') OR is_smishing_up)"
SQL["x1_stream_classify"] = traffic_sql(f""", gs AS (SELECT *, {_WARN} AS warns FROM scu)
SELECT event_id, {_CLS} AS classification, CASE WHEN NOT {_BAD} THEN is_spam END AS is_spam,
  CASE WHEN NOT {_BAD} THEN is_smishing_up END AS is_smishing, CASE WHEN NOT {_BAD} THEN round(confidence, 6) END AS confidence,
  CASE WHEN NOT {_BAD} THEN risk_level END AS risk_level, {_BAD} AS is_error, via_sms, CASE WHEN {_BAD} THEN {q(D.REPLY_ERROR)}
       WHEN is_spam THEN concat(CASE WHEN is_smishing_up THEN {q(D.REPLY_SMISHING_TITLE)} ELSE {q(D.REPLY_SPAM_TITLE)} END,
         chr(10), 'Confidence: ', {_PCT}, '%', chr(10), 'Risk: ', upper(risk_level), chr(10), chr(10),
         CASE WHEN len(warns) > 0 THEN concat(array_to_string(warns, chr(10)), chr(10)) ELSE '' END,
         CASE WHEN is_smishing_up THEN {sql_text(D.REPLY_SMISHING_ADVICE)} ELSE {sql_text(D.REPLY_SPAM_ADVICE)} END)
       ELSE concat({q(D.REPLY_SAFE_ICON + ' SAFE (')}, {_PCT}, '% confidence)', chr(10), chr(10), {q(D.REPLY_SAFE_BODY)}) END AS reply
FROM gs""", scored=True)
SQL["x2_stream_daily_counters"] = traffic_sql(f"""SELECT date, count(*) AS total_messages, count(*) FILTER (WHERE {_SPAM}) AS spam_count,
  count(*) FILTER (WHERE {_SPAM} AND is_smishing_up) AS smishing_count, count(*) FILTER (WHERE NOT ({_SPAM})) AS ham_count,
  count(*) FILTER (WHERE via_sms) AS sms_received FROM scu WHERE NOT {_BAD} GROUP BY date""", scored=True)
SQL["x3_stream_spend_gate"] = traffic_sql("SELECT event_id, date, accepted, alert FROM gt")
SQL["x5_stream_dashboard"] = traffic_sql(f"""SELECT strftime(time_bucket(INTERVAL '1 minute', ts), {TS}) AS bucket_start, count(*) AS total,
  count(*) FILTER (WHERE {_SPAM}) AS spam, count(*) FILTER (WHERE NOT ({_SPAM})) AS ham FROM scu WHERE NOT {_BAD} GROUP BY 1""", scored=True)
SQL["s1_delimited_roundtrip"] = with_view("SELECT true_label AS label, concat(message_id, ' ', text) AS message, CAST(NULL AS VARCHAR) AS bad FROM m WHERE source <> 'documents'")
SQL["s2_role_detection"] = with_view("SELECT coalesce(true_label, 'none') AS label, sha256(concat(message_id, ' ', text)) AS message_sha FROM m WHERE source = 'documents'")
SQL["s3_named_columns"] = with_view("SELECT true_label AS label, concat(message_id, ' ', text) AS message FROM m WHERE source = 'events'")
SQL["e9_ensemble_candidates_any_f1"] = SQL["e9_ensemble_candidates"].replace("f1_score >= 0.9", "f1_score >= 0.0")
SQL["m5_weighted_ensemble_any_f1"] = SQL["m5_weighted_ensemble"].replace("f1_score >= 0.9", "f1_score >= 0.0")
