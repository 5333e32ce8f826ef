"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

import re

_REST = "coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '')"

_OP8 = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract({_REST}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT n, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)
"""

ORACLES: dict[str, str] = {"op8_url_filter": _OP8}

# How many control strings a text holds, each counted by itself; each is one character longer when formatted.
_CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_MARKS = "(" + " + ".join(r"len(regexp_extract_all({0}, '" + re.escape(c[0]) + r"\\*" + re.escape(c[1:]) + "'))" for c in _CONTROL) + ")"

_OP10 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
g AS (
  SELECT conv_id, count(*) AS n_turns, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text)[1] AS first, (coalesce(conv_id, 0) % 3 + 3) % 3 AS nth,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length(role) + {_MARKS.format('role')} + length(text) + {_MARKS.format('text')} + length('<|im_start|><|im_sep|><|im_end|>') + 1) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
       CASE WHEN roles = ['user', 'assistant'] THEN ['completion+prompt', 'answer+question', 'instruction+output'][nth + 1]
            WHEN roles = ['system', 'user', 'assistant'] AND first <> '' THEN 'answer+question+system'
            ELSE ['messages.role.text', 'turns.role.content', 'conversations.from.value'][nth + 1] END AS layout
FROM g
"""

ORACLES["op10_chat"] = _OP10

# Words are runs of anything but the six ASCII white-space characters.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["digest_op2"] = """
WITH t AS (SELECT count(*) AS n FROM documents), s AS (SELECT CAST(i AS INT) AS shard, CAST(n // 40 + CASE WHEN i < n % 40 THEN 1 ELSE 0 END AS BIGINT) AS rows FROM range(40) r(i), t)
SELECT shard, rows, rows AS slots, CAST(0 AS BIGINT) AS first, rows - 1 AS last, (SELECT CAST(sum(strlen(coalesce(text, '')) + 16) AS BIGINT) FROM documents) AS bytes FROM s WHERE rows > 0
"""

ORACLES["digest_op5"] = r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
FROM documents
"""

ORACLES["digest_op9"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
x AS (SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS k FROM d),
y AS (SELECT r, k, a, lead(a) OVER v AS b, lead(a, 2) OVER v AS c FROM x WINDOW v AS (PARTITION BY r ORDER BY k)),
win AS (SELECT r, k, count(*) OVER (PARTITION BY r, a, b, c) AS times FROM y WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT k + o) AS n FROM win, (VALUES (0), (1), (2)) v(o) WHERE times > 1 GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
"""

ORACLES["digest_op7"] = rf"""
WITH RECURSIVE s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS source_size FROM documents GROUP BY source),
t AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, 3.0 * source_size AS cap FROM s),
l(round, level) AS (SELECT 0, CAST(0 AS DOUBLE) UNION ALL SELECT round + 1, (SELECT CAST((sum(source_size) - coalesce(sum(cap) FILTER (cap / w < level), 0)) / sum(w) FILTER (cap / w >= level) AS DOUBLE) FROM t) FROM l WHERE round < 30)
SELECT source, source_size, round(least(cap, w * (SELECT max(level) FROM l)), 3) AS target FROM t
"""

ORACLES["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0),
p AS (SELECT anchor_id, id, score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) QUALIFY rank <= 10
"""

ORACLES["op11_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
