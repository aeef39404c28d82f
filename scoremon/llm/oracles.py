"""SQL of the registered queries of this subpackage, for DuckDB over the same tables."""

from __future__ import annotations

#: One row ``t``: what each byte does to a CRC-32.  The polynomial is a fixed value.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(
      [n::UBIGINT] || list_transform(range(8), lambda i: 0::UBIGINT),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS v
    FROM range(256) r(n)))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of an expression, beside ``crc_table``."""
    return f"""xor(4294967295::UBIGINT, list_reduce(
      [4294967295::UBIGINT] || list_transform(range(length(hex(encode({text}))) // 2),
        lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::UBIGINT),
      lambda c, b: xor(t[(xor(c, b) & 255)::INT + 1], c >> 8)))"""


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name} END"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
hashed AS (
  SELECT doc_id, source, sha256({_LEAF} || {_field('text')}) AS leaf,
    CASE WHEN {crc32('doc_id::VARCHAR')} % 5 = 0
      THEN sha256({_LEAF} || {_field(LOWERED)}) END AS found
  FROM documents, crc_table),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM hashed),
up AS (
  SELECT 0 AS level, tree, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM leaves
  UNION ALL
  SELECT level + 1, tree, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(width) + 15) // 16
  FROM up WHERE width > 1 GROUP BY level, tree, pos // 16),
subroots AS (SELECT tree, digest FROM up WHERE width = 1),
top AS (
  SELECT 0 AS level, tree - 1 AS pos, digest, count(*) OVER () AS width FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(width) + 15) // 16
  FROM top WHERE width > 1 GROUP BY level, pos // 16),
all_up AS (
  SELECT tree, level, pos, digest FROM up WHERE width > 1
  UNION ALL SELECT 0, level, pos, digest FROM top WHERE width > 1),
steps AS (
  SELECT n.tree, n.level, n.pos,
    coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < n.pos), '') AS "left",
    coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > n.pos), '') AS "right"
  FROM all_up n JOIN all_up s ON s.tree = n.tree AND s.level = n.level AND s.pos // 16 = n.pos // 16
  GROUP BY n.tree, n.level, n.pos),
paths AS (
  SELECT l.tree, l.pos, list({{'l': s."left", 'r': s."right"}} ORDER BY s.level) AS path
  FROM leaves l JOIN steps s ON s.tree = l.tree AND s.pos = l.pos // (16 ** s.level)::BIGINT
  GROUP BY l.tree, l.pos),
tops AS (
  SELECT u.tree, u.digest AS subroot,
    (SELECT list({{'l': s."left", 'r': s."right"}} ORDER BY s.level) FROM steps s
     WHERE s.tree = 0 AND s.pos = (u.tree - 1) // (16 ** s.level)::BIGINT) AS path
  FROM subroots u),
whole AS (
  SELECT l.doc_id, l.leaf, l.found, t.subroot, (SELECT digest FROM top WHERE width = 1) AS root,
    coalesce(p.path, []) || coalesce(t.path, []) AS path
  FROM leaves l JOIN tops t ON t.tree = l.tree LEFT JOIN paths p ON p.tree = l.tree AND p.pos = l.pos),
folded AS (
  SELECT *, list_reduce(
    [{{'l': '', 'r': coalesce(found, leaf)}}] || path,
    lambda a, s: {{'l': '', 'r': sha256(s.l || a.r || s.r)}}).r AS folded_root
  FROM whole)
SELECT doc_id, leaf, subroot, root,
  sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM folded
"""

TOPK = """
WITH numbers AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM numbers q JOIN numbers c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
found AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
  FROM documents),
runs AS (
  SELECT doc_id, {LOWERED.replace("text", "run")} AS run, count(*) AS n
  FROM found WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, crc_table),
spoilt AS (
  SELECT n, CASE WHEN h % 31 = 0
    THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (
  SELECT word, n, i, substr(word, 1, i::INT) AS a, substr(word, i::INT + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n
  FROM holes x JOIN holes y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON y.word = x.a || x.b),
best AS (
  SELECT word, count(*) AS n_near, (list(other ORDER BY other_n DESC, other))[1] AS other, max(other_n) AS other_n
  FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form,
    CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS here, form AS following FROM formed
  UNION ALL
  SELECT k.word, f.word, f.form FROM walk k JOIN formed f ON f.word = k.following)
SELECT f.word, f.form, k.here AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk k ON k.word = f.word AND k.following IS NULL
"""

#: Turns that are not answers are calls, an answer is the result of the turn before it.
TOOL_CALLS = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 't' || turn AS call_id, coalesce(role, 'unknown') AS name, text
  FROM conversations WHERE role IS NULL OR role <> 'assistant'),
results AS (
  SELECT conv_id, 't' || (turn - 1) AS call_id, count(*) AS n,
    (list({'place': turn, 'content': text} ORDER BY turn NULLS FIRST, text NULLS FIRST))[1].content AS content
  FROM conversations WHERE role = 'assistant' GROUP BY ALL),
known AS (SELECT DISTINCT conv_id, turn FROM calls WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
placed AS (
  SELECT k.conv_id, k.turn, 0 AS level FROM known k
  WHERE k.turn < 2 OR NOT EXISTS (SELECT 1 FROM known w WHERE w.conv_id = k.conv_id AND w.turn = k.turn - 2)
  UNION ALL
  SELECT k.conv_id, k.turn, p.level + 1 FROM placed p
  JOIN known k ON k.conv_id = p.conv_id AND k.turn = p.turn + 2 AND k.turn >= 2),
judged AS (
  SELECT c.*, p.level,
    CASE name WHEN 'user' THEN coalesce(length(text) BETWEEN 1 AND 360 AND c.turn >= 0, false)
      WHEN 'system' THEN coalesce(length(text) >= 1, false) ELSE true END AS valid,
    '{' || array_to_string(list_filter([
      '"text":' || to_json(text)::VARCHAR, '"turn":' || c.turn,
      '"uses":[' || CASE WHEN c.turn >= 2 THEN '"t' || (c.turn - 2) || '"' ELSE '' END || ']'],
      lambda f: f IS NOT NULL), ',') || '}' AS arguments
  FROM calls c LEFT JOIN placed p USING (conv_id, turn)),
whole AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.name,
    c.level::INT AS level, c.valid, r.n IS NOT NULL AND c.name IS NOT NULL AS linked,
    coalesce(r.n, 0)::BIGINT AS n_results, c.arguments, r.content
  FROM judged c FULL JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id)
SELECT conv_id, call_id, name, level, valid, linked, n_results,
  '{"arguments":' || coalesce(arguments, 'null') || ',"id":' || coalesce(to_json(call_id)::VARCHAR, 'null')
  || ',"level":' || coalesce(level::VARCHAR, 'null') || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
  || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"valid":' || coalesce(valid::VARCHAR, 'null')
  || '}' AS line
FROM whole
"""

REPEATS = """
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(encode(text), ''::BLOB) AS b FROM documents),
starts AS (SELECT rid, doc_id, b, unnest(range(1, octet_length(b) - 48)) AS p FROM texts WHERE doc_id IS NOT NULL),
windows AS (SELECT rid, doc_id, p, md5_number(b[p:p + 49]) AS w FROM starts),
least_doc AS (SELECT w, min(doc_id) AS low FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
found AS (SELECT rid, p FROM windows JOIN least_doc USING (w) WHERE low < doc_id),
heads AS (
  SELECT rid, p, coalesce(p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 50, true) AS new FROM found),
numbered AS (SELECT rid, p, sum(new::INT) OVER (PARTITION BY rid ORDER BY p) AS k FROM heads),
spans AS (SELECT rid, k, min(p) AS a, max(p) + 50 AS z FROM numbered GROUP BY rid, k),
gaps AS (
  SELECT rid, lag(z, 1, 1) OVER (PARTITION BY rid ORDER BY k) AS a, a AS z FROM spans
  UNION ALL
  SELECT t.rid, coalesce(max(s.z), 1), any_value(octet_length(t.b)) + 1
  FROM texts t LEFT JOIN spans s ON s.rid = t.rid GROUP BY t.rid),
kept AS (
  SELECT g.rid, string_agg(CASE WHEN g.z > g.a THEN hex(t.b[g.a:g.z - 1]) ELSE '' END, '' ORDER BY g.a, g.z) AS h
  FROM gaps g JOIN texts t ON t.rid = g.rid GROUP BY g.rid),
sums AS (SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid)
SELECT t.doc_id, octet_length(t.b)::BIGINT AS n_bytes, coalesce(s.n_removed, 0)::BIGINT AS n_removed,
  coalesce(s.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM texts t JOIN kept k ON k.rid = t.rid LEFT JOIN sums s ON s.rid = t.rid
"""

NEAR_TEXTS = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared h JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * h.n >= 80 * (p.n + q.n - h.n)),
reach AS (
  SELECT a AS doc_id, b AS other FROM links
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT t.doc_id, coalesce(any_value(z.n), 0)::BIGINT AS n_shingles, least(t.doc_id, min(r.other)) AS component_id
FROM texts t LEFT JOIN sizes z USING (doc_id) LEFT JOIN reach r USING (doc_id) GROUP BY t.doc_id
"""

_WORDS = f"coalesce(regexp_extract_all({LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

LEAKS = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
texts AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
pieces AS (
  SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT rid, k, w, unnest(range(1, len(w) - k + 2)) AS i
        FROM texts, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT p.rid, p.k, p.i, v.item_id FROM pieces p JOIN windows v ON v.k = p.k AND v.s = p.s),
hits AS (
  SELECT rid, count(DISTINCT word_at) AS n
  FROM (SELECT rid, unnest(range(i, i + k)) AS word_at FROM (SELECT DISTINCT rid, k, i FROM found)) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(m.n, 0)::BIGINT AS n_items,
  sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM texts t LEFT JOIN hits h USING (rid) LEFT JOIN named m USING (rid)
"""
