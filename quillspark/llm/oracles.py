"""DuckDB SQL for the queries that SQL can express, on the same tables."""

from __future__ import annotations

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP3 = r"""
WITH page AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT r, source, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM page),
total AS (SELECT source, count(*) AS pages FROM page GROUP BY source),
bad AS (
  SELECT c.source, c.line
  FROM (SELECT source, line, count(DISTINCT r) AS n FROM line WHERE trim(line) <> '' GROUP BY source, line) c
       JOIN total ON total.source IS NOT DISTINCT FROM c.source WHERE n >= 5 AND n > 0.1 * pages),
judged AS (
  SELECT r, p, line.line, trim(line.line) <> '' AS has_text, bad.line IS NOT NULL AS gone
  FROM line LEFT JOIN bad ON line.source IS NOT DISTINCT FROM bad.source AND line.line = bad.line)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (has_text) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       CASE WHEN any_value(lines) IS NOT NULL THEN coalesce(string_agg(judged.line, chr(10) ORDER BY p) FILTER (NOT gone), '') END AS text
FROM page LEFT JOIN judged USING (r) GROUP BY r
"""

OP4 = r"""
WITH RECURSIVE message AS (
  SELECT row_number() OVER () AS r, * FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
line AS (
  SELECT r, conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM message),
level AS (
  SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks FROM line),
leveled AS (
  SELECT r, conv_id, turn, p, line, length(marks) - length(replace(marks, '>', '')) AS level,
         regexp_replace(line, '^(?:[ \t]*>)+', '') AS content FROM level),
body AS (
  SELECT r, conv_id, turn, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY p)
           FILTER (level = 0 AND NOT regexp_matches(line, '^On .* wrote:[ \t]*$')), ''), '^\s+|\s+$', '', 'g') AS body
  FROM leveled GROUP BY r, conv_id, turn),
run AS (
  SELECT r, conv_id, turn, level, p - row_number() OVER (PARTITION BY r, level ORDER BY p) AS g, p, content FROM leveled),
passage AS (
  SELECT r, conv_id, turn, level,
         trim(regexp_replace(lower(string_agg(content, chr(10) ORDER BY p)), '\s+', ' ', 'g')) AS t
  FROM run WHERE level > 0 GROUP BY r, conv_id, turn, level, g),
unit AS (
  SELECT conv_id, turn, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) AS t
  FROM (SELECT conv_id, turn, unnest([body] || regexp_split_to_array(body, '\n[ \t]*\n') || string_split(body, chr(10))) AS u FROM body)),
original AS (
  SELECT conv_id, t, min(turn) AS source_turn FROM unit WHERE t <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, t),
linked AS (
  SELECT q.r, q.conv_id, q.turn, q.level, CASE WHEN o.source_turn < q.turn THEN o.source_turn END AS source
  FROM passage q LEFT JOIN original o ON q.conv_id = o.conv_id AND q.t = o.t WHERE q.t <> ''),
quoted AS (
  SELECT r, conv_id, turn, count(*) AS n_quotes, count(source) AS n_linked, max(source) FILTER (level = 1) AS reply_to
  FROM linked GROUP BY r, conv_id, turn),
reply AS (
  SELECT conv_id, turn, max(reply_to) AS reply_to FROM quoted WHERE reply_to IS NOT NULL GROUP BY conv_id, turn),
up(conv_id, turn, thread, depth) AS (
  SELECT conv_id, turn, reply_to, 1 FROM reply
  UNION ALL SELECT u.conv_id, u.turn, p.reply_to, u.depth + 1 FROM up u JOIN reply p ON p.conv_id = u.conv_id AND p.turn = u.thread),
top AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY conv_id, turn)
SELECT m.conv_id, coalesce(thread, m.turn) AS thread, m.turn, role, reply.reply_to, CAST(coalesce(depth, 0) AS BIGINT) AS depth,
       CAST(coalesce(n_quotes, 0) AS BIGINT) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked, body AS text,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || body AS formatted
FROM message m JOIN body USING (r) LEFT JOIN quoted USING (r)
     LEFT JOIN reply ON reply.conv_id = m.conv_id AND reply.turn = m.turn LEFT JOIN top ON top.conv_id = m.conv_id AND top.turn = m.turn
"""

OP7 = rf"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[p : p + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM doc),
found AS (
  SELECT r, p, k, item_id
  FROM (SELECT r, p, k, array_to_string(w[p : p + k - 1], ' ') AS g
        FROM pos, (SELECT DISTINCT k FROM win) WHERE p + k - 1 <= len(w)) JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit
        FROM (SELECT r, unnest(range(p, p + k)) AS q FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""

OP9 = rf"""
WITH RECURSIVE doc AS (
  SELECT DISTINCT doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id
       JOIN size sa ON sa.doc_id = a.doc_id JOIN size sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, sa.n, sb.n HAVING 100 * count(*) >= 80 * (sa.n + sb.n - count(*))),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT e.y, r.root FROM reach r JOIN edge e ON e.x = r.doc_id),
group_of AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN group_of USING (doc_id) LEFT JOIN size USING (doc_id)
"""

OP12 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM doc),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM doc) GROUP BY r, t),
item AS (
  SELECT item_id, t, count(*) AS c
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, {AZ}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
score AS (
  SELECT item_id, r, doc_id, CAST(sum(c * weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * len(doc.w) * nd) // l)))) AS BIGINT) AS score
  FROM item JOIN weight USING (t) JOIN tf USING (t) JOIN doc USING (r), total GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

OP13 = """
WITH one AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
row_of AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM one),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM row_of a JOIN row_of b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""

ORACLES: dict[str, str] = {"op3_line_dedup": OP3, "op4_chat_threads": OP4, "op7_decontamination": OP7, "op9_near_duplicates": OP9, "op12_ranked_search": OP12, "op13_hard_negatives": OP13}
