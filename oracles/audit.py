"""The audit chain as SQL: attempts, typing, merge, backfill, then the SQL of rules and canonical tables over its fields."""

from auditloom.plans import scenario

from .base import DOCS, FIELD_RESULTS, FIELDS, MEASURES, RULES, VERDICTS, WIDE, staged_number, with_
from .canonical import _MSG, _SUM_COLS, CANON, INV, RUNS
from .extraction import _MERGE
from .rules import ERR, EVAL, MERGED, PIVOT
from .views import FACTS, LAB, VIEWS
from .views import SQL as _VIEW_SQL

_NAMES = "[" + ", ".join(f"'{f[1]}'" for f in scenario.FIELDS) + "]"
_ATTEMPTS = f"""tries AS (SELECT r.doc_id, r.field_name, r.invoice_type_id, f.field_id, f.data_type, j AS seq,
  CASE WHEN j = 1 THEN CASE WHEN (doc_id + i) % 4 <> 0 THEN '<b>' || value_text || '</b>' END WHEN j = 2 THEN CASE WHEN (doc_id + i) % 3 = 0 THEN value_text END ELSE value_text END AS t,
  ((doc_id * 7 + i * 13 + j * 31) % 101) / 100.0::DOUBLE AS confidence, CAST(1 + (doc_id + i + j) % 3 AS INTEGER) AS source_page, 'r' || j AS source_region
  FROM (SELECT *, list_position({_NAMES}, field_name) - 1 AS i FROM raw_results) r JOIN fields f USING (invoice_type_id, field_name)
  CROSS JOIN (VALUES (1), (2), (3)) x(j) WHERE j < 3 OR doc_id % 3 = 0)"""
_TYPED = """cleaned AS (SELECT *, trim(replace(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '&#\\d+;', ' ', 'g'), '&nbsp;', ' ')) AS s FROM typed),
src AS (SELECT doc_id, field_name, seq, confidence, source_page, source_region, CASE WHEN data_type = 'decimal' THEN coalesce(CAST(num AS VARCHAR), t)
  WHEN lower(s) IN ('', 'null', 'none') THEN NULL WHEN field_name = 'currency' THEN CASE lower(s) WHEN 'eur' THEN 'EUR' WHEN 'usd' THEN 'USD' WHEN 'gbp' THEN 'GBP' END ELSE s END AS value_text FROM cleaned)"""
_HELD = """held AS MATERIALIZED (SELECT h.*, d.invoice_type_id, q.field_id FROM (
""" + "WITH " + _MERGE.format(page="v.source_page, v.source_region,", at="") + """) h JOIN docs d USING (doc_id) JOIN fields q USING (invoice_type_id, field_name))"""
_FILLED = """offers AS (SELECT doc_id, field_name, rule_id, page_num, CASE field_name WHEN 'currency' THEN 'EUR' ELSE 'Seller ' || rule_id END AS offer FROM (
    SELECT doc_id, rule_id, rule_order, page_num, unnest(CASE WHEN doc_id % 2 = 0 THEN ['currency', 'vendor_name'] ELSE ['vendor_name'] END) AS field_name FROM verdicts WHERE passes)
  QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY rule_order) = 1),
field_results AS MATERIALIZED (SELECT h.doc_id, h.invoice_type_id, h.field_id, h.field_name, CASE WHEN take THEN offer ELSE value_text END AS value_text,
  CASE WHEN take THEN page_num ELSE source_page END AS source_page, CASE WHEN take THEN 'visual_' || rule_id || '_field_updates' ELSE source_region END AS source_region, take AS flagged_for_review
  FROM (SELECT h.*, o.rule_id, o.page_num, o.offer, o.offer IS NOT NULL AND (value_text IS NULL OR value_text IN ('', 'null')) AS take FROM held h LEFT JOIN offers o USING (doc_id, field_name)) h)"""
_STATUS = f"""st AS (SELECT doc_id, bool_or(skip_kind = 'visual') AS pending, bool_or(({ERR}) OR (status = 'skipped' AND severity = 'error')) AS blocked FROM res GROUP BY doc_id),
fl AS (SELECT doc_id, bool_or(flagged_for_review) AS fl FROM field_results GROUP BY doc_id),
runs AS (SELECT r.* REPLACE (CASE WHEN coalesce(pending, false) THEN 'running' WHEN fl THEN 'needs_review' WHEN blocked THEN 'failed' ELSE 'passed' END AS agent_raw,
  CASE WHEN coalesce(pending, false) THEN '' ELSE 'completed' END AS finish_reason) FROM runs0 r JOIN st USING (doc_id) JOIN fl USING (doc_id))"""
_CHAIN = (
    RULES, FIELDS, DOCS, MEASURES, WIDE, FIELD_RESULTS.replace("field_results AS (", "raw_results AS (", 1), VERDICTS, _ATTEMPTS,
    staged_number("tries", "t", "num", "typed"), _TYPED, _HELD, _FILLED, staged_number("field_results", "value_text", "num", "fn"),
    PIVOT, EVAL, MERGED[len(VERDICTS) + 2:], RUNS.replace("runs AS (", "runs0 AS (", 1), _STATUS, INV)
_GONE = """CASE y.rule_name WHEN 'gross_total_matches' THEN concat_ws(', ', CASE WHEN net IS NULL THEN 'net_amount' END, CASE WHEN tax IS NULL THEN 'tax_amount' END)
  WHEN 'line_total_matches' THEN concat_ws(', ', CASE WHEN unit_rate IS NULL THEN 'unit_rate' END, CASE WHEN units IS NULL THEN 'units' END)
  WHEN 'ratio_check' THEN concat_ws(', ', CASE WHEN net IS NULL THEN 'net_amount' END, CASE WHEN units IS NULL THEN 'units' END) END"""
_TOLD = f"""CASE WHEN y.check_type = 'cross_field' AND s.status = 'skipped' THEN 'Cross-field check skipped (missing values): ' ||
  CASE WHEN {_GONE} <> '' THEN 'Missing extracted values for field(s): ' || {_GONE} WHEN y.rule_name = 'ratio_check' THEN 'expression cannot be evaluated'
    ELSE 'Could not parse actual value ''' || coalesce(v, 'None') || ''' as number' END ELSE {_MSG} END"""
_RESULTS = f"""msg AS (SELECT s.*, {_TOLD} AS message FROM res s JOIN y ON y.doc_id = s.doc_id AND y.rule_id = s.rule_id),
cr AS (SELECT m.doc_id, run_id, invoice_id, invoice_file, source_type, source_id, source_hash, m.invoice_type_id, m.rule_id, m.rule_name, m.field_id, m.status,
  CASE WHEN m.status = 'failed' AND m.severity = 'warning' THEN 'warning' ELSE m.status END AS normalized_status, m.severity, m.message, coalesce(m.agent_notes, '') AS agent_notes,
  coalesce(CAST(f.source_page AS VARCHAR), '') AS source_page, coalesce('p' || f.source_page || ':' || f.source_region, '') AS evidence_refs
  FROM msg m JOIN runs u ON u.doc_id = m.doc_id LEFT JOIN field_results f ON f.doc_id = m.doc_id AND f.field_id = m.field_id)"""
_REVIEWED = _RESULTS.replace(" AS evidence_refs\n", " AS evidence_refs, '' AS policy_refs\n", 1)


def _over_chain(name: str, given: tuple[str, ...], own: tuple[str, ...], columns: str = "*") -> str:
    """SQL of a view over the chain's canonical rows instead of those it is written for."""
    body = _VIEW_SQL[name].removeprefix(with_(*given))
    return with_(*_CHAIN, _REVIEWED, *own) + f"SELECT {columns} FROM ({body})"


_INVOICES = with_(*_CHAIN) + f"SELECT {_SUM_COLS} FROM inv"

SQL = {
    "audit_pipeline": _INVOICES,
    "audit_pipeline_batches": _INVOICES,
    "audit_results": with_(*_CHAIN, _RESULTS) + "SELECT '1' AS schema_version, * EXCLUDE (doc_id) FROM cr",
    "audit_counts": with_(*_CHAIN, """nr AS (SELECT rule_id, CASE WHEN status = 'failed' AND severity = 'warning' THEN 'warning' ELSE status END AS ns FROM res),
cells AS (SELECT 'Invoice review' AS section, 'Review status' AS metric, review_status AS value FROM inv UNION ALL SELECT 'Run status', 'Agent status', agent_status FROM inv
  UNION ALL SELECT 'Documents', invoice_type_id, review_status FROM inv UNION ALL SELECT 'Compliance status', 'Rule results', ns FROM nr UNION ALL SELECT 'Rule results', rule_id, ns FROM nr)""")
    + "SELECT section, metric, value, count(*) AS count FROM cells GROUP BY ALL",
    "audit_dashboard": _over_chain("dashboard", VIEWS, (LAB, FACTS)),
    "audit_review_queue": _over_chain("review_queue", VIEWS, (LAB, FACTS), "* EXCLUDE (policy_summary)"),
    "audit_review_issues": _over_chain("review_issues", VIEWS, (LAB, FACTS), "* EXCLUDE (policy_summary)"),
    "audit_matrix": _over_chain("compliance_matrix", CANON, ()),
}
