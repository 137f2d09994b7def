"""SQL counterparts of the registered queries, where SQL can express them."""

from __future__ import annotations

OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS place,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), sources AS (
  SELECT source, sum(size) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS slot,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
  FROM sized GROUP BY source
), reach AS (
  SELECT *, 3.0 * source_size AS most, sum(source_size) OVER () AS total,
         coalesce(sum(3.0 * source_size) OVER before, 0) AS used,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open
  FROM sources
  WINDOW before AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (total - used) / open AS level FROM reach
  WHERE most >= (total - used) / open * weight ORDER BY used LIMIT 1
), goals AS (
  SELECT source, slot, source_size, least(most, coalesce((SELECT level FROM level) * weight, most)) AS target FROM reach
), placed AS (
  SELECT s.doc_id, s.size, g.slot, g.source_size, g.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         coalesce(floor(g.target / nullif(g.source_size, 0)), 0) AS passes
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), counted AS (
  SELECT *, CAST(passes + CASE WHEN start + size / 2.0 < target - passes * source_size THEN 1 ELSE 0 END AS INTEGER) AS copies,
         least(1.0, CAST(start + size / 2.0 AS DOUBLE) / nullif(CAST(target AS DOUBLE), 0)) AS share
  FROM placed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size,
       CAST(target AS DOUBLE) AS target, CAST(size * copies AS BIGINT) AS taken, copies,
       round(CASE WHEN copies > 0 THEN least(1.0, coalesce(CASE slot
         WHEN 0 THEN 2 * 5 * share / (7 + sqrt(greatest(49 - 8 * 5 * share, 0)))
         WHEN 1 THEN CASE WHEN 2 * share >= 0.75 THEN 0.5 + 2 * (2 * share - 0.75) / (2 + sqrt(4 + 4 * (2 * share - 0.75)))
                          ELSE 2 * 2 * share / (1 + sqrt(1 + 4 * 2 * share)) END
         ELSE 2 * share / (0.5 + sqrt(0.25 + 2 * share)) END, 1.0)) END, 6) AS position
FROM counted
"""

OP7 = """
WITH ints AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP12 = """
WITH ints AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM ints a JOIN ints c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same
  ) WHERE place <= 5
), paired AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.vec_id AS negative_id, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
   AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM paired WHERE rank <= 3
"""

# 3988292384 is the reversed polynomial of CRC-32; the table follows from it.
OP13 = """
WITH RECURSIVE steps AS (
  SELECT CAST(range AS BIGINT) AS byte, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
), walk AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS digits, 0 AS step, CAST(4294967295 AS BIGINT) AS state
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT w.conv_id, w.digits, w.step + 1, xor(w.state // 256, t.c)
  FROM walk w JOIN steps t ON t.k = 8 AND t.byte = xor(w.state, CAST(ascii(substr(w.digits, w.step + 1, 1)) AS BIGINT)) % 256
  WHERE w.step < len(w.digits)
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, xor(state, 4294967295) % 6 AS h FROM walk WHERE step = len(digits)
), heads AS (
  SELECT c.conv_id, c.h, t.pos, t.role, t.text FROM convs c
  JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h
), rebuilt AS (
  SELECT conv_id, pos, role, text FROM heads
  UNION ALL
  SELECT t.conv_id, t.pos - c.h + coalesce(k.taken, 0), t.role, t.text
  FROM turns t JOIN convs c ON t.conv_id = c.conv_id
  LEFT JOIN (SELECT conv_id, count(*) AS taken FROM heads GROUP BY conv_id) k ON k.conv_id = c.conv_id
  WHERE t.pos > c.h
), prefixes AS (
  SELECT conv_id, pos AS depth, len(text) AS chars,
         md5(string_agg(md5(concat(role, ':', text)), ',') OVER sofar) AS node,
         CASE WHEN pos = 1 THEN 'root' ELSE md5(string_agg(md5(concat(role, ':', text)), ',') OVER earlier) END AS above,
         count(*) OVER (PARTITION BY conv_id) AS size
  FROM rebuilt
  WINDOW sofar AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         earlier AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), members AS (
  SELECT conv_id, depth, chars, node, above, size FROM prefixes
  UNION ALL
  SELECT c.conv_id, 0, 0, 'root', NULL, coalesce((SELECT count(*) FROM rebuilt r WHERE r.conv_id = c.conv_id), 0) FROM convs c
), nodes AS (
  SELECT node, depth, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
         sha256(coalesce(string_agg(CASE WHEN size = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY node, depth
), linked AS (
  SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.above = n.node AND c.depth = n.depth + 1) AS n_children FROM nodes n
), totals AS (
  SELECT m.node, m.depth, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((d.n_convs - 1) * d.chars) AS saved_tokens
  FROM members m JOIN members b ON b.conv_id = m.conv_id AND b.depth >= m.depth
  JOIN linked d ON d.node = b.node AND d.depth = b.depth AND d.conv_id = b.conv_id
  GROUP BY m.node, m.depth
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children,
       CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM linked n JOIN totals t ON t.node = n.node AND t.depth = n.depth
LEFT JOIN nodes p ON p.node = n.above AND p.depth = n.depth - 1
"""

ORACLES: dict[str, str] = {
    "op2_curriculum": OP2, "op7_top_inner_products": OP7, "op12_hard_negatives": OP12, "op13_conversation_trie": OP13,
}
