"""DuckDB twins of the training-data queries that SQL can express."""

from __future__ import annotations


def crc32_table() -> list[int]:
    """The table of the reflected polynomial 0xEDB88320."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


OP4 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS d FROM v),
s AS (SELECT q.r AS q, c.r AS c, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM c q JOIN v ON v.r = q.r AND v.vec_id % 50 = 0 JOIN c ON q.d = c.d AND q.r <> c.r GROUP BY ALL),
r AS (SELECT a.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, b.vec_id NULLS LAST) AS INTEGER) AS rank, b.vec_id, score
  FROM s JOIN v a ON a.r = q JOIN v b ON b.r = c)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP10 = f"""
WITH tbl AS (SELECT {crc32_table()}::BIGINT[] AS t),
b AS (SELECT doc_id, source, coalesce(hex(encode(text)), '') AS x FROM documents),
k AS (SELECT doc_id, source, CAST(len(x) // 2 + 8 AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(x, '..'), lambda y: CAST('0x' || y AS BIGINT))),
    lambda a, y: xor(a >> 8, t[(xor(a, y) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM b, tbl),
h AS (SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS source_key,
  md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(text_crc32 AS VARCHAR)) AS h FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY h, doc_id, size, text_crc32) AS r, count(*) OVER (PARTITION BY source_key) AS n FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY CAST(2 * r - 1 AS DOUBLE) / CAST(2 * n AS DOUBLE), source_key, r) - 1 AS pos, count(*) OVER () AS total FROM r)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(pos * 24 // total AS INTEGER) AS shard,
  CAST(pos - ((pos * 24 // total) * total + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""

SQL = {"op4_topk": OP4, "op10_sharding": OP10}

#: Base 32 of the SHA-1: 160 bits as 32 letters of five.
OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(regexp_extract_all(array_to_string(list_transform(regexp_extract_all(x, '.'),
  lambda c: right(bin(CAST('0x1' || c AS INTEGER)), 4)), ''), '.....'),
  lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_prepend(0, list_transform(regexp_extract_all(g, '.'), lambda y: CAST(y AS INTEGER))), lambda u, v: 2 * u + v), 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY x) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM b
"""

SQL["op1_warc"] = OP1

OP3 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
  AND len(list_filter(x, lambda e: e <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

SQL["op3_pstable"] = OP3

OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
e AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS d FROM v),
s AS (SELECT a.r AS a, b.r AS b, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM e a JOIN v q ON a.r = q.r AND q.vec_id % 50 = 0 JOIN e b ON a.d = b.d AND a.r <> b.r GROUP BY ALL),
t AS (SELECT a, b, x.vec_id AS anchor_id, y.vec_id AS id, x.label = y.label AS same, score FROM s JOIN v x ON x.r = a JOIN v y ON y.r = b),
p AS (SELECT * FROM t WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, t.id AS negative_id, t.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY t.score DESC, t.id NULLS LAST) AS INTEGER) AS rank
  FROM p JOIN t ON t.a = p.a AND NOT t.same AND 50 * p.score <= 100 * t.score AND 100 * t.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

SQL["op13_hardnegatives"] = OP13
