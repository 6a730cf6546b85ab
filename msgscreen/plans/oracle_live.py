"""SQL twins of :mod:`catalog_live`: a live job's results are its batch form's."""

from __future__ import annotations

from .oracle import with_view
from .oracle_queries import CORPUS_CTES, SQL, TS, traffic_sql

SQL["x3_stream_gate_shuffled"] = traffic_sql("SELECT event_id, date, accepted, alert, CAST(spend_before AS DECIMAL(18,4)) AS spend_before FROM gt")
SQL["t10_stream_override"] = SQL["t10_manual_override"]
SQL["x7_stream_rate_limit"] = SQL["x7_sender_rate_limit"]
SQL["x8_stream_sessions"] = f"SELECT sender, messages, session_start, session_end, unusual FROM ({SQL['x8_sender_sessions']})"
SQL["x8_stream_spikes"] = SQL["x8_volume_spikes"]
SQL["x2_stream_counters_upserted"] = SQL["x2_stream_daily_counters"]
SQL["x5_stream_dashboard_upserted"] = SQL["x5_stream_dashboard"]
SQL["x1_stream_outbox_history"] = f"""WITH x AS ({SQL['x1_stream_classify']}), t AS ({traffic_sql('SELECT event_id, date, text, sender FROM tr')})
SELECT x.event_id, x.classification, x.confidence, x.is_error, x.reply, CASE WHEN NOT x.is_error THEN t.date END AS date,
  CASE WHEN NOT x.is_error THEN length(t.text) END AS message_length,
  CASE WHEN NOT x.is_error THEN sha256(concat('msgscreen', t.sender)) END AS from_number_hash FROM x JOIN t USING (event_id)"""
SQL["x4_stream_retraining_sets"] = with_view(CORPUS_CTES + f""",
fb AS (SELECT d.text AS message, make_timestamp(CAST((1704067200 + doc_id * 37) AS BIGINT) * 1000000) AS ts,
  (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS trigger FROM documents d JOIN labels l USING (doc_id)),
cm AS (SELECT message FROM cd WHERE source IN ('pages', 'documents')),
tg AS (SELECT trigger, count(*) AS corrections, min(ts) AS first_ts, max(ts) AS trigger_ts, count(DISTINCT message) AS from_feedback FROM fb GROUP BY trigger HAVING count(*) = 100),
sh AS (SELECT trigger, count(*) AS shared FROM (SELECT DISTINCT trigger, message FROM fb) f JOIN cm USING (message) GROUP BY trigger)
SELECT trigger, corrections, strftime(first_ts, {TS}) AS first_ts, strftime(trigger_ts, {TS}) AS trigger_ts, from_feedback,
  (SELECT count(*) FROM cm) - coalesce(shared, 0) AS from_corpus FROM tg LEFT JOIN sh USING (trigger)""")
