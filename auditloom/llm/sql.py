"""DuckDB SQL of the operations that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from . import line_dedup
from . import quality_rules as rules

EXACT_SEARCH = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(CAST(x AS DOUBLE) * 256) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

QUALITY_RULES = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, g FROM g GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM g JOIN twice USING (r, g)) GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM w),
m AS (
  SELECT r, l, regexp_matches(l, '[^\x20\x09-\x0D]') AS filled, length(l) - length(replace(l, ' ', '')) + 1 AS n,
    len(regexp_extract_all(l, '{rules.SYMBOLS}')) AS symbols, len(regexp_extract_all(l, '[!?]{{2,}}')) AS shouts,
    length(l) - length(replace(l, '{rules.SEPARATOR}', '')) AS separators FROM l),
b AS (
  SELECT r, l, filled, filled AND ((symbols >= 3 AND separators >= 3 AND separators * 4 >= n) OR symbols * 2 >= n OR shouts * 2 >= n
    OR (n >= {rules.PUNCTUATION_MIN_WORDS} AND NOT regexp_matches(l, '{rules.PUNCTUATION}'))
    OR (n <= {rules.BOILERPLATE_MAX_WORDS} AND regexp_matches(lower(l), '{"|".join(rules.BOILERPLATE)}'))) AS bad FROM m),
lines AS (
  SELECT r, count(*) FILTER (filled) - count(DISTINCT l) FILTER (filled) AS n_dup_lines,
    coalesce(sum(length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (bad), 0) AS removed FROM b GROUP BY r),
x AS (
  SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(t, '{rules.SYMBOLS}')) AS n_symbols,
    n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, removed
  FROM w JOIN lines USING (r) LEFT JOIN covered USING (r)),
y AS (
  SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    CAST(word_chars - removed AS BIGINT) AS left_chars FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 10 * left_chars >= {rules.KEEP_TENTHS} * word_chars AS kept, left_chars FROM y
"""

LINE_DEDUP = rf"""
WITH l AS (
  SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ascii_uppercase}', '{ascii_lowercase}') AS key
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
s AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= {line_dedup.MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), 'null')) >= {line_dedup.MIN_DOCS}),
m AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id IS DISTINCT FROM keeper AS dropped FROM l LEFT JOIN s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

ORACLE_SQL: dict[str, str] = {"op4_exact_search": EXACT_SEARCH, "op10_quality_rules": QUALITY_RULES, "op13_line_dedup": LINE_DEDUP}
