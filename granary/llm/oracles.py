"""DuckDB SQL for the queries of this package that SQL can express on whole tables.

The others, line templates, library tokenizers, page extraction, passages and leaks, are tested against brute force
in tests/llm.
"""

from __future__ import annotations

from granary.llm.quality import STOP_WORDS

_WORDS = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1) GROUP BY r),
m AS (SELECT l.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words,
  len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•]'))) AS bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS dots
  FROM l LEFT JOIN rep ON rep.r = l.r),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 20 AND word_chars::DOUBLE / n_words BETWEEN 2 AND 20 AND n_symbols::DOUBLE / n_words <= 0.1 AND n_stop_words::DOUBLE / n_words >= 0.03
  AND n_dup_lines::DOUBLE / n_lines <= 0.5 AND bullets::DOUBLE / n_lines <= 0.9 AND dots::DOUBLE / n_lines <= 0.3 AS kept, n_lines, n_stop_words
FROM b"""

OP6 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS prev FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
e AS (SELECT *, replace(replace(replace(role, '\\', '\\b'), '<|', '<\\|'), chr(10), '\\n') AS r, replace(replace(text, '\\', '\\b'), '<|', '<\\|') AS x,
  CASE coalesce(prev, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE FALSE END AS allowed FROM o),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '') AS loss,
  sum(length('<|im_start|>') + length(r) + 1 + length(x) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars, min(CASE WHEN NOT allowed THEN i END) AS bad, arg_max(role, i) AS last FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, bad IS NULL AND last = 'assistant' AS valid, coalesce(bad, CASE WHEN last <> 'assistant' THEN n_turns END) AS first_bad_turn
FROM g"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS start, doc_id AS node FROM documents UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node)
SELECT s.doc_id, len(s.s) AS n_shingles, c.component_id, c.component_id = s.doc_id AS kept FROM s JOIN (SELECT start, min(node) AS component_id FROM r GROUP BY start) c ON c.start = s.doc_id"""

_NIBBLE = "(strpos('0123456789abcdef', substr(h, {}, 1)) - 1)"
_FIVE = f"((({_NIBBLE.format('(5 * i) // 4 + 1')} * 16 + {_NIBBLE.format('(5 * i) // 4 + 2')}) >> (3 - (5 * i) % 4)) & 31)"

OP10 = f"""
WITH h AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM h)
SELECT page_id, strlen(t) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_FIVE} AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

SQL: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op6_chat_formatting": OP6,
    "op7_minhash_near_dedup": OP7,
    "op10_warc": OP10,
}
