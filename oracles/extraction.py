from auditloom.plans import scenario

from .base import ATTEMPTS, DOCS, FIELD_RESULTS, FIELDS, MEASURES, RULES, VERDICTS, WIDE, staged_number, with_

_MERGE = """a AS (SELECT *, coalesce(confidence, 0.5) AS conf, row_number() OVER w AS pos,
  last_value(CASE WHEN value_text IS NULL THEN coalesce(confidence, 0.5) END IGNORE NULLS) OVER (PARTITION BY doc_id, field_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held
  FROM src WINDOW w AS (PARTITION BY doc_id, field_name ORDER BY seq)),
f AS (SELECT doc_id, field_name, min(pos) AS pos0 FROM a WHERE value_text IS NOT NULL AND (held IS NULL OR conf > held) GROUP BY ALL),
v AS (SELECT a.*, row_number() OVER (PARTITION BY a.doc_id, a.field_name ORDER BY conf DESC, a.pos) AS rk FROM a JOIN f USING (doc_id, field_name) WHERE value_text IS NOT NULL AND a.pos >= pos0),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_name ORDER BY seq DESC) AS rk FROM a WHERE value_text IS NULL),
g AS (SELECT doc_id, field_name, count(*) AS retry_count FROM a GROUP BY ALL)
SELECT g.doc_id, g.field_name, v.value_text, {page} coalesce(v.conf, n.conf) AS confidence, {at} g.retry_count,
  v.conf IS NOT NULL AND v.conf >= 0.65::DOUBLE AND v.conf < 0.85::DOUBLE AS batch_review
FROM g LEFT JOIN v ON v.doc_id = g.doc_id AND v.field_name = g.field_name AND v.rk = 1
LEFT JOIN n ON n.doc_id = g.doc_id AND n.field_name = g.field_name AND n.rk = 1"""
FR = (DOCS, MEASURES, WIDE, FIELD_RESULTS)
_NAMES = "[" + ", ".join(f"'{f[1]}'" for f in scenario.FIELDS) + "]"
_TRIED = f"tried AS (SELECT l_orderkey AS doc_id, {_NAMES}[1 + l_partkey % 12] AS field_name, l_linenumber AS pos FROM lineitem)"
_UNTRIED = "untried AS (SELECT d.doc_id, f.field_name FROM docs d JOIN fields f USING (invoice_type_id) WHERE NOT EXISTS (SELECT 1 FROM tried t WHERE t.doc_id = d.doc_id AND t.field_name = f.field_name))"

SQL = {
    "merge_extractions": with_(ATTEMPTS, "src AS (SELECT * FROM attempts)") [:-1] + ",\n" + _MERGE.format(
        page="v.source_page,", at="coalesce(v.pos, n.pos) AS extraction_attempts,"),
    "merge_extractions_ignore_nulls": with_(ATTEMPTS, "src AS (SELECT * FROM attempts WHERE value_text IS NOT NULL)")[:-1] + ",\n" + _MERGE.format(page="", at=""),
    "coerce_attempts": with_(FIELDS, *FR, """raw AS (SELECT r.doc_id, r.field_name, f.field_id, f.data_type, r.confidence,
  CASE WHEN r.field_name = 'vendor_name' THEN '<b>' || value_text || '</b>&nbsp;' ELSE value_text END AS t FROM field_results r JOIN fields f USING (invoice_type_id, field_name))""",
                             staged_number("raw", "t", "num", "nn"),
                             "c AS (SELECT *, trim(replace(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '&#\\d+;', ' ', 'g'), '&nbsp;', ' ')) AS s FROM nn)")
    + """SELECT doc_id, field_id, field_name, CASE WHEN data_type = 'decimal' THEN t WHEN lower(s) IN ('', 'null', 'none') THEN NULL
  WHEN field_name = 'currency' THEN CASE lower(s) WHEN 'eur' THEN 'EUR' WHEN 'usd' THEN 'USD' WHEN 'gbp' THEN 'GBP' END ELSE s END AS value_text,
  CASE WHEN data_type = 'decimal' THEN num END AS value_num, confidence FROM c""",
    "field_retry_counts": "SELECT l_orderkey AS doc_id, l_returnflag AS field_name, count(*) AS retry_count FROM lineitem GROUP BY ALL",
    "confidence_band": with_(*FR) + """SELECT doc_id, field_name, CASE WHEN flagged_for_review OR value_text IS NULL OR confidence < 0.65::DOUBLE THEN 'attention' WHEN confidence < 0.85::DOUBLE THEN 'batch_review' ELSE 'done' END AS band FROM field_results""",
    "flag_for_review": with_(*FR) + """SELECT doc_id, field_id, field_name, value_text, confidence, flagged_for_review OR (field_name = 'currency' AND doc_id % 2 = 0) AS flagged_for_review,
  CASE WHEN field_name = 'currency' AND doc_id % 2 = 0 THEN 'look at doc-' || doc_id || '.pdf' END AS review_reason FROM field_results
UNION ALL SELECT doc_id, 'payment_method', 'payment_method', NULL, 0.0, true, 'look at ' || invoice_file FROM docs WHERE doc_id % 2 <> 0""",
    "backfill_fields": with_(RULES, *FR, VERDICTS, """o AS (SELECT doc_id, rule_id, rule_order, page_num, unnest(CASE WHEN doc_id % 2 = 0 THEN ['currency', 'vendor_name'] ELSE ['vendor_name'] END) AS field_name FROM verdicts WHERE passes),
p AS (SELECT *, CASE field_name WHEN 'currency' THEN 'EUR' ELSE 'Seller ' || rule_id END AS offer FROM o QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY rule_order) = 1),
j AS (SELECT r.*, p.rule_id, p.page_num, p.offer, p.offer IS NOT NULL AND (value_text IS NULL OR value_text IN ('', 'null')) AS take FROM field_results r LEFT JOIN p USING (doc_id, field_name))""")
    + """SELECT doc_id, field_name, CASE WHEN take THEN offer ELSE value_text END AS value_text, CASE WHEN take THEN 0.86::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN take THEN page_num ELSE source_page END AS source_page, CASE WHEN take THEN 'visual_' || rule_id || '_field_updates' ELSE 'body' END AS source_region,
  take OR flagged_for_review AS flagged_for_review, CASE WHEN take THEN 'Suggested by visual compliance ' || rule_id || ' (field_updates) — verify' END AS review_reason, take AS backfilled FROM j""",
    "unattempted_fields": with_(FIELDS, DOCS, _TRIED, _UNTRIED) + "SELECT * FROM untried",
    "next_field_batch": with_(FIELDS, DOCS, _TRIED, _UNTRIED, """asked AS (SELECT doc_id, field_name, 0 AS rk, min(pos) AS pos FROM tried GROUP BY ALL),
u AS (SELECT * FROM asked UNION ALL SELECT doc_id, field_name, 1, 0 FROM untried)""")
    + "SELECT doc_id, field_name, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rk, pos, field_name) AS INTEGER) AS slot, rk = 1 AS added FROM u",
}
