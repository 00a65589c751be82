from .base import DOCS, FIELD_RESULTS, MEASURES, RULES, WIDE, with_
from .rules import ERR, RESULTS, WARN

RUNS = """runs AS (SELECT doc_id, 'run-' || doc_id AS run_id, 'doc-' || doc_id AS invoice_id, invoice_file, '/in/' || invoice_file AS pdf_path,
  CASE WHEN doc_id % 3 = 0 THEN 'google_drive' ELSE 'local' END AS source_type,
  CASE WHEN doc_id % 3 = 0 THEN 'gd' || doc_id ELSE '/in/' || invoice_file END AS source_id,
  CASE WHEN doc_id % 3 = 0 THEN 'gdrive://gd' || doc_id WHEN doc_id % 2 = 0 THEN 'file:///in/' || invoice_file ELSE '' END AS source_uri,
  left(sha256(CASE WHEN doc_id % 3 = 0 THEN 'gd' || doc_id ELSE '/in/' || invoice_file END), 12) AS source_hash, CAST(doc_id % 5 AS VARCHAR) AS revision_id,
  invoice_type_id, ['passed', 'passed', 'failed', 'needs_review', 'interrupted', 'running'][1 + o_custkey % 6] AS agent_raw,
  CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'done' END AS finish_reason, o_custkey % 30 AS turns_used,
  CASE WHEN doc_id % 7 = 0 THEN 'https://view/' || doc_id END AS web_view_link FROM docs)"""
AGENT = "CASE agent_raw WHEN 'interrupted' THEN 'error' WHEN 'running' THEN 'unknown' ELSE agent_raw END"
_MSG = """CASE WHEN s.check_type = 'visual_check' THEN s.vmessage WHEN s.status = 'passed' THEN 'OK'
  WHEN y.check_type = 'regex' AND blank THEN 'Value is null/missing, cannot match pattern ' || check_value
  WHEN y.check_type IN ('range', 'enum') AND blank AND s.status = 'failed' THEN 'Value is null/missing, cannot run ' || y.check_type || ' check'
  WHEN y.check_type IN ('range', 'enum') AND blank THEN 'Value missing/null — skipping ' || y.check_type || ' check'
  WHEN y.check_type = 'range' AND n IS NULL AND s.status = 'failed' THEN 'Could not parse value ''' || v || ''' as number for range check'
  WHEN y.check_type = 'range' AND n IS NULL THEN 'Unparseable numeric value ''' || v || ''' — skipped for optional field'
  WHEN y.check_type = 'cross_field' AND s.status = 'failed' THEN printf('Expected ~%.2f (scaled) or ~%.2f (unscaled), got %.2f', e1, e2, n)
  WHEN y.check_type = 'cross_field' AND y.rule_name = 'gross_total_matches' AND (net IS NULL OR tax IS NULL) THEN 'Cross-field check skipped (missing values): Missing extracted values for field(s): ' || concat_ws(', ', CASE WHEN net IS NULL THEN 'net_amount' END, CASE WHEN tax IS NULL THEN 'tax_amount' END)
  WHEN y.check_type = 'cross_field' AND y.rule_name = 'line_total_matches' AND units IS NULL THEN 'Cross-field check skipped (missing values): Missing extracted values for field(s): unit_rate, units'
  WHEN y.check_type = 'cross_field' AND y.rule_name = 'ratio_check' AND units IS NULL THEN 'Cross-field check skipped (missing values): Missing extracted values for field(s): net_amount, units'
  WHEN y.check_type = 'cross_field' AND y.rule_name = 'ratio_check' THEN 'Cross-field check skipped (missing values): expression cannot be evaluated'
  WHEN y.check_type = 'conditional_check' AND s.status = 'skipped' THEN 'Condition not met, rule skipped'
  WHEN y.check_type = 'checksum' THEN 'Unknown check_type: checksum' ELSE s.error_message END"""
MESSAGES = f"msg AS (SELECT s.*, {_MSG} AS message FROM res s JOIN y ON y.doc_id = s.doc_id AND y.rule_id = s.rule_id)"
CR = """cr AS (SELECT m.doc_id, run_id, invoice_id, invoice_file, source_type, source_id, source_hash, m.invoice_type_id, m.rule_id, m.rule_name, m.field_id, m.status,
  CASE WHEN m.status = 'failed' AND m.severity = 'warning' THEN 'warning' ELSE m.status END AS normalized_status, m.severity, m.message, coalesce(m.agent_notes, '') AS agent_notes,
  coalesce(CAST(f.source_page AS VARCHAR), '') AS source_page,
  CASE WHEN m.doc_id % 20 = 0 THEN 'no supplier seen' WHEN m.doc_id % 10 = 0 THEN 'p2: supplier quotation' WHEN m.rule_order % 2 = 0 THEN 'p' || (1 + m.doc_id % 3) || ':totals' ELSE '' END AS evidence_refs,
  CASE m.rule_order % 4 WHEN 0 THEN '{"snippet_id": "L' || lpad(CAST(m.doc_id % 50 AS VARCHAR), 3, '0') || '", "source": "learnings"}'
    WHEN 1 THEN '{"snippet_id": "' || m.rule_id || '", "source": "rules"}; see ' || m.rule_id || ' page 2' WHEN 2 THEN '{"title": "Guide", "snippet_id": "S1"}' ELSE '' END AS policy_refs
  FROM msg m JOIN runs u ON u.doc_id = m.doc_id LEFT JOIN field_results f ON f.doc_id = m.doc_id AND f.field_id = m.field_id)"""
INV = f"""va AS (SELECT doc_id, count(*) AS rules_total, count(*) FILTER (status = 'passed') AS rules_passed, count(*) FILTER ({ERR}) AS rules_failed_error, count(*) FILTER ({WARN}) AS rules_failed_warning,
  coalesce(string_agg(rule_id, '; ' ORDER BY rule_order) FILTER ({ERR}), '') AS error_failed_rule_ids, coalesce(string_agg(rule_id, '; ' ORDER BY rule_order) FILTER ({WARN}), '') AS warning_failed_rule_ids FROM res GROUP BY doc_id),
fa AS (SELECT doc_id, count(*) AS fields_extracted, count(*) FILTER (flagged_for_review) AS fields_flagged,
  {', '.join(f"coalesce(max(value_text) FILTER (field_name = '{n}'), '') AS {n}" for n in ('vendor_name', 'vendor_vat_id', 'invoice_number', 'invoice_date', 'currency', 'gross_amount', 'net_amount', 'tax_amount'))} FROM field_results GROUP BY doc_id),
inv AS (SELECT '1' AS schema_version, u.* EXCLUDE (agent_raw), {AGENT} AS agent_status, fa.* EXCLUDE (doc_id), va.* EXCLUDE (doc_id),
  CASE WHEN {AGENT} IN ('error', 'needs_review') THEN {AGENT} WHEN fields_flagged > 0 OR rules_failed_error > 0 THEN 'needs_review' WHEN rules_failed_warning > 0 THEN 'warning'
    WHEN {AGENT} IN ('passed', 'failed') THEN {AGENT} ELSE 'unknown' END AS review_status FROM runs u JOIN fa ON fa.doc_id = u.doc_id JOIN va ON va.doc_id = u.doc_id)"""
SUMMARY = (*RESULTS, RUNS, INV)
CANON = (*SUMMARY, MESSAGES, CR)
FR = (DOCS, MEASURES, WIDE, FIELD_RESULTS)
_SUM_COLS = "schema_version, run_id, invoice_id, invoice_file, pdf_path, source_type, source_id, source_uri, source_hash, revision_id, invoice_type_id, agent_status, review_status, finish_reason, CAST(turns_used AS VARCHAR) AS turns_used, CAST(fields_extracted AS VARCHAR) AS fields_extracted, CAST(fields_flagged AS VARCHAR) AS fields_flagged, CAST(rules_total AS VARCHAR) AS rules_total, CAST(rules_passed AS VARCHAR) AS rules_passed, CAST(rules_failed_error AS VARCHAR) AS rules_failed_error, CAST(rules_failed_warning AS VARCHAR) AS rules_failed_warning, error_failed_rule_ids, warning_failed_rule_ids, vendor_name, vendor_vat_id, invoice_number, invoice_date, currency, gross_amount, net_amount, tax_amount"

SQL = {
    "canonical_invoice_summary": with_(*SUMMARY) + f"SELECT {_SUM_COLS} FROM inv",
    "canonical_compliance_results": with_(*CANON) + "SELECT '1' AS schema_version, * EXCLUDE (doc_id) FROM cr",
    "normalize_agent_status": with_(DOCS, RUNS) + f"SELECT doc_id, {AGENT} AS agent_status FROM runs",
    "normalize_rule_status": with_(*RESULTS) + """SELECT doc_id, rule_id, CASE WHEN rule_order % 5 = 0 THEN 'flagged' WHEN rule_order % 7 = 0 THEN 'unknown' WHEN status = 'failed' AND severity = 'warning' THEN 'warning' ELSE status END AS status FROM res""",
    "review_status": with_(*SUMMARY) + "SELECT agent_status, review_status, count(*) AS documents FROM inv GROUP BY ALL",
    "enrich_invoices": with_(DOCS, MEASURES, WIDE, RUNS) + "SELECT run_id, coalesce(web_view_link, '') AS web_view_link, 'line_total|reverse_charge|unit_rate|units|vat_rate' AS extra_names, coalesce(CAST(units AS VARCHAR), '') AS units FROM runs JOIN wide USING (doc_id)",
    "source_page_of_rule": with_(RULES, *FR) + "SELECT d.doc_id, r.rule_id, f.source_page FROM docs d JOIN rules r USING (invoice_type_id) LEFT JOIN field_results f ON f.doc_id = d.doc_id AND f.field_id = r.field_id",
    "high_value_fields": with_(*FR) + "SELECT doc_id, count(*) AS fields_extracted, count(*) FILTER (flagged_for_review) AS fields_flagged, "
    + ", ".join(f"max(value_text) FILTER (field_name = '{n}') AS {n}" for n in ("vendor_name", "vendor_vat_id", "invoice_number", "invoice_date", "currency", "gross_amount", "net_amount", "tax_amount")) + " FROM field_results GROUP BY doc_id",
    "write_fields_table": with_(*FR) + """SELECT 'doc-' || doc_id || '.pdf' AS invoice_file, invoice_type_id, field_id, field_name, coalesce(value_text, '') AS extracted_value, printf('%.2f', confidence) AS confidence,
CAST(source_page AS VARCHAR) AS source_page, 'body' AS source_region, '1' AS extraction_attempts, CASE WHEN flagged_for_review THEN 'True' ELSE 'False' END AS flagged_for_review,
CASE WHEN confidence BETWEEN 0.65::DOUBLE AND 0.8499::DOUBLE THEN 'True' ELSE 'False' END AS batch_review, '' AS review_reason FROM field_results""",
    "write_rule_results_table": with_(*CANON) + "SELECT invoice_file, invoice_type_id, rule_id, rule_name, field_id, status, severity, message, agent_notes FROM cr",
    "run_summary_rows": with_(*SUMMARY) + """SELECT '20240101_000000' AS "timestamp", invoice_file, pdf_path, invoice_type_id, agent_status, CAST(turns_used AS VARCHAR) AS turns_used, finish_reason, CAST(fields_extracted AS VARCHAR) AS fields_extracted, CAST(fields_flagged AS VARCHAR) AS fields_flagged, CAST(rules_total AS VARCHAR) AS rules_total, CAST(rules_passed AS VARCHAR) AS rules_passed, CAST(rules_failed_error AS VARCHAR) AS rules_failed_error, CAST(rules_failed_warning AS VARCHAR) AS rules_failed_warning, source_type, source_id, source_hash, run_id FROM inv""",
    "stringify_cells": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS flag, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END AS maybe,
o_orderstatus || '; ; ' || o_orderpriority AS items, '{"page":' || o_custkey || ',"source":"' || o_orderstatus || '"}' AS refs, 'x; ' || o_orderstatus AS slots FROM orders""",
    "outcome_needs_review": with_(*SUMMARY) + """SELECT run_id, invoice_id, CASE WHEN agent_status = 'error' THEN 'error' WHEN rules_failed_error > 0 OR fields_flagged > 0 OR agent_status IN ('needs_review', 'failed') THEN 'needs_review' ELSE 'ok' END AS outcome,
CASE WHEN agent_status <> 'error' THEN rules_failed_error > 0 OR fields_flagged > 0 OR agent_status IN ('needs_review', 'failed') END AS needs_review,
CASE WHEN agent_status = 'error' THEN 'agent returned ERROR for ' || invoice_file || ': ' || CASE WHEN finish_reason = '' THEN 'unknown' ELSE finish_reason END END AS error FROM inv""",
    "sink_metrics": with_(*CANON) + "SELECT 'invoice_summary' AS table_name, count(*) AS rows, count(*) * 31 AS cells FROM inv UNION ALL SELECT 'compliance_results', count(*), count(*) * 19 FROM cr",
}
