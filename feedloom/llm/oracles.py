"""DuckDB SQL for the registered queries of this folder that SQL can express."""

from __future__ import annotations

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

def clusters_sql(k: int = 40, rounds: int = 5, size: int = 64, salt: str = "2:") -> str:
    """All rounds written out: vectors, then centroids and distances by turns."""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id, x, row_number() OVER (ORDER BY vec_id, x) AS r FROM (
  SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {size}))""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INT AS cluster, x AS c
  FROM (SELECT sha256('{salt}' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL) ORDER BY h, x LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min(struct_pack(d := d, cluster := cluster)) AS m FROM (
  SELECT r, vec_id, x, cluster, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v CROSS JOIN c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""e{i} AS (SELECT m.cluster AS cluster, unnest(range(1, {size + 1})) AS p, unnest(x) AS y FROM a{i}),
f{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c FROM
  (SELECT cluster, p, sum(y) AS s, count(*) AS n FROM e{i} GROUP BY cluster, p) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(f{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN f{i} USING (cluster))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, m.cluster AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.cluster)::BIGINT AS cluster_inertia,
  sum(m.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON cluster = m.cluster"""


SQL = {
    "op1_warc": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
    substr('{BASE32}', (((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT >> (15 - 5 * j)::INT) & 31) + 1)::INT, 1)), 'string_agg', '')),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g""",
    "op5_minhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(c) AS c FROM r GROUP BY 1) USING (doc_id)""",
    "op7_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.a = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1) USING (vec_id)
JOIN (SELECT a AS vec_id, min(c) AS c FROM r GROUP BY 1) USING (vec_id)""",
    "op8_suffixes": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, (2 * p + 1)::BIGINT, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
o AS (SELECT doc_id, p, lag(p) OVER x AS before, lead(p) OVER x AS after FROM w JOIN m USING (s) WHERE doc_id > first
      WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
a AS (SELECT doc_id, p AS a, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o WHERE before IS NULL OR p > before + 50),
z AS (SELECT doc_id, p + 50 AS z, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o WHERE after IS NULL OR after > p + 50),
i AS (SELECT doc_id, k, a, z FROM a JOIN z USING (doc_id, k)),
g AS (SELECT doc_id, k, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS f FROM i
      UNION ALL SELECT doc_id, 1 + coalesce(max(k), 0), any_value(len(h) // 2), coalesce(max(z), 0) FROM d LEFT JOIN i USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(substr(h, (2 * f + 1)::BIGINT, (2 * (a - f))::BIGINT), '' ORDER BY k) AS kept FROM g JOIN d USING (doc_id) GROUP BY 1),
c AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans FROM i GROUP BY 1)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op9_decontaminate": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared, count(*) / n_item_shingles AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item_shingles HAVING 10 * count(*) >= 8 * n_item_shingles""",
    "op10_chat": r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
f AS (SELECT *, 24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\/>'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS n,
  row_number() OVER w AS rn, count(*) OVER (PARTITION BY conv_id) AS total
  FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY rn) AS upto FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (WHERE role = 'assistant' OR rn = total))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
    "op12_centroids": clusters_sql(),
}
