from .base import DOCS, FIELD_RESULTS, FIELDS, MEASURES, RULES, VERDICTS, WIDE, staged_number, with_

BASE = (RULES, FIELDS, DOCS, MEASURES, WIDE, FIELD_RESULTS, staged_number("field_results", "value_text", "num", "fn"))
PIVOT = """p AS (SELECT doc_id,
  max(num) FILTER (field_name = 'net_amount') AS net, max(num) FILTER (field_name = 'tax_amount') AS tax,
  max(num) FILTER (field_name = 'units') AS units, max(num) FILTER (field_name = 'unit_rate') AS unit_rate,
  max(value_text) FILTER (field_name = 'reverse_charge') AS rev, max(value_text) FILTER (field_name = 'vat_rate') AS vat, max(num) FILTER (field_name = 'vat_rate') AS vat_num,
  bool_or(field_name IN ('invoice_number', 'invoice_date', 'vendor_name') AND value_text IS NOT NULL AND value_text NOT IN ('', 'null')) AS any_ref
  FROM fn GROUP BY doc_id)"""
EVAL = """x AS (SELECT d.doc_id, r.*, f.value_text AS v, f.num AS n, f.value_text IS NULL OR f.value_text IN ('', 'null') AS blank,
  coalesce((SELECT max(required) FROM fields q WHERE q.field_id = r.field_id), true) AS req, p.* EXCLUDE (doc_id)
  FROM docs d JOIN rules r USING (invoice_type_id) LEFT JOIN fn f ON f.doc_id = d.doc_id AND f.field_id = r.field_id LEFT JOIN p ON p.doc_id = d.doc_id),
y AS (SELECT *, CASE rule_name WHEN 'gross_total_matches' THEN net + tax
    WHEN 'line_total_matches' THEN units * CASE WHEN unit_rate > 1 THEN unit_rate / 100 ELSE unit_rate END END AS e1,
  CASE rule_name WHEN 'gross_total_matches' THEN net + tax WHEN 'line_total_matches' THEN units * unit_rate END AS e2 FROM x),
ev AS (SELECT doc_id, invoice_type_id, rule_id, rule_name, field_id, check_type, severity, error_message, rule_order, v,
  CASE check_type
    WHEN 'required' THEN CASE WHEN blank THEN 'failed' ELSE 'passed' END
    WHEN 'regex' THEN CASE WHEN blank THEN CASE WHEN req THEN 'failed' ELSE 'skipped' END WHEN regexp_matches(v, '^(?:' || check_value || ')') THEN 'passed' ELSE 'failed' END
    WHEN 'range' THEN CASE WHEN blank THEN CASE WHEN req THEN 'failed' ELSE 'skipped' END WHEN n IS NULL THEN CASE WHEN req THEN 'failed' ELSE 'skipped' END
      WHEN n BETWEEN CAST(split_part(check_value, ',', 1) AS DOUBLE) AND CAST(split_part(check_value, ',', 2) AS DOUBLE) THEN 'passed' ELSE 'failed' END
    WHEN 'enum' THEN CASE WHEN blank THEN CASE WHEN req THEN 'failed' ELSE 'skipped' END WHEN upper(trim(v)) IN ('EUR', 'USD', 'GBP') THEN 'passed' ELSE 'failed' END
    WHEN 'cross_field' THEN CASE WHEN e1 IS NULL OR e2 IS NULL OR n IS NULL THEN 'skipped' WHEN abs(e1 - n) <= 0.02::DOUBLE OR abs(e2 - n) <= 0.02::DOUBLE THEN 'passed' ELSE 'failed' END
    WHEN 'conditional_check' THEN CASE WHEN lower(coalesce(rev, 'none')) <> 'true' THEN 'skipped' WHEN vat IS NULL OR vat_num = 0 OR vat = '0' THEN 'passed' ELSE 'failed' END
    WHEN 'required_one_of' THEN CASE WHEN any_ref THEN 'passed' ELSE 'failed' END ELSE 'skipped' END AS status FROM y),
e0 AS (SELECT *, CASE WHEN status = 'skipped' THEN CASE WHEN check_type = 'visual_check' THEN 'visual' ELSE 'missing' END END AS skip_kind FROM ev)"""
MERGED = VERDICTS + """,
res AS (SELECT e.doc_id, e.invoice_type_id, e.rule_id, e.rule_name, e.field_id, e.check_type, e.severity, e.error_message, e.rule_order,
  CASE WHEN w.rule_id IS NOT NULL THEN CASE WHEN w.passes THEN 'passed' ELSE 'failed' END ELSE e.status END AS status,
  CASE WHEN w.rule_id IS NULL THEN e.skip_kind END AS skip_kind,
  CASE WHEN w.rule_id IS NOT NULL THEN coalesce(w.observation, 'No observation') WHEN e.check_type = 'visual_check' THEN 'Visual check — call check_compliance_visual(image_path, page_num) to evaluate' END AS vmessage,
  CASE WHEN w.rule_id IS NOT NULL THEN printf('visual check page %d, confidence=%.2f', w.page_num, coalesce(w.confidence, 0.5)) END AS agent_notes
  FROM e0 e LEFT JOIN verdicts w ON w.doc_id = e.doc_id AND w.rule_id = e.rule_id)"""
EVALUATED = (*BASE, PIVOT, EVAL)
RESULTS = (*EVALUATED, MERGED)
_KINDS = {"required": "required", "regex": "regex", "range": "range", "enum": "enum", "cross_field": "cross_field",
          "conditional": "conditional_check", "required_one_of": "required_one_of", "visual": "visual_check", "unknown_type": "checksum"}


def _ids(cond: str) -> str:
    return f"coalesce(string_agg(rule_id, ';' ORDER BY rule_order) FILTER ({cond}), '')"


ERR, WARN = "status = 'failed' AND severity = 'error'", "status = 'failed' AND severity = 'warning'"
SQL = {
    **{f"check_{name}": with_(*EVALUATED) + f"SELECT doc_id, rule_id, status, severity, skip_kind FROM e0 WHERE check_type = '{kind}'" for name, kind in _KINDS.items()},
    "evaluate_rules": with_(*EVALUATED) + "SELECT doc_id, rule_id, field_id, status, severity, skip_kind, rule_order FROM e0",
    "field_required_lookup": with_(RULES, FIELDS, DOCS) + "SELECT doc_id, rule_id, coalesce((SELECT max(required) FROM fields q WHERE q.field_id = r.field_id), true) AS required FROM docs JOIN rules r USING (invoice_type_id)",
    "resolve_field": with_(*BASE) + """SELECT d.doc_id, r.rule_id, coalesce(f.field_name, CASE WHEN rule_order % 2 = 0 THEN r.field_id ELSE 'units' END) AS field_name, f.value_text
FROM docs d JOIN rules r USING (invoice_type_id) LEFT JOIN field_results f ON f.doc_id = d.doc_id AND ((rule_order % 2 = 0 AND f.field_id = r.field_id) OR (rule_order % 2 = 1 AND f.field_name = 'units'))""",
    "sticky_verdicts": with_(*EVALUATED) + """SELECT doc_id, rule_id, CASE WHEN rule_order % 3 = 0 AND doc_id % 2 = 0 THEN 'passed' ELSE status END AS status,
rule_order % 3 = 0 AND (doc_id % 2 = 0 OR status IN ('passed', 'failed')) AS kept FROM e0""",
    "merge_visual_verdicts": with_(*RESULTS) + "SELECT doc_id, rule_id, status, vmessage AS message, agent_notes, skip_kind FROM res WHERE check_type = 'visual_check'",
    "rule_verdict_summary": with_(*RESULTS) + f"SELECT doc_id, count(*) AS rules_total, count(*) FILTER (status = 'passed') AS passed_count, {_ids(ERR)} AS errors, {_ids(WARN)} AS warnings FROM res GROUP BY doc_id",
    "compliance_report": with_(*RESULTS) + f"""SELECT doc_id, count(*) AS total_rules, count(*) FILTER (status = 'passed') AS passed, {_ids(ERR)} AS failed_errors, {_ids(WARN)} AS failed_warnings,
{_ids("skip_kind = 'missing'")} AS skipped_checks, {_ids("skip_kind = 'visual'")} AS visual_checks_pending,
count(*) FILTER (({ERR}) OR skip_kind = 'visual' OR (skip_kind = 'missing' AND severity = 'error')) = 0 AS all_errors_resolved FROM res GROUP BY doc_id""",
    "rule_state": with_(*RESULTS) + "SELECT doc_id, rule_id, CASE status WHEN 'passed' THEN CASE WHEN rule_order % 2 = 0 THEN 'finalized_pass' ELSE 'needs_review' END WHEN 'failed' THEN 'finalized_fail' ELSE 'candidate' END AS rule_state FROM res",
    "finish_status": with_(*RESULTS, f"""s AS (SELECT doc_id, bool_or(skip_kind = 'visual') AS pending, bool_or({ERR}) AS ef, bool_or(status = 'skipped' AND severity = 'error') AS es, bool_or({WARN}) AS w FROM res GROUP BY doc_id),
t AS (SELECT doc_id, bool_or(flagged_for_review) AS fl FROM field_results GROUP BY doc_id),
u AS (SELECT doc_id, NOT coalesce(pending, false) AS finished, ef, es, w, fl FROM s JOIN t USING (doc_id))""")
    + """SELECT doc_id, finished, CASE WHEN NOT finished THEN 'running' WHEN fl THEN 'needs_review' WHEN ef OR es THEN 'failed' ELSE 'passed' END AS status,
CASE WHEN NOT finished THEN NULL WHEN ef OR es THEN 'Run status reflects blocking error-severity rule failures or incomplete error evidence.'
WHEN w THEN 'No blocking error-severity failures; warning-level rules may still be non-pass (listed in warning_failures).'
WHEN fl THEN 'No rule blockers; one or more fields are flagged for human review.' ELSE 'All evaluated rules passed at error severity; no flags.' END AS status_explanation,
ef AS error_failed, es AS error_skipped, es AS unresolved_error_evidence FROM u""",
    "remaining_gaps": with_(*BASE, PIVOT) + """SELECT DISTINCT doc_id, unnest(list_filter([CASE WHEN net IS NULL THEN 'net_amount' END, CASE WHEN tax IS NULL THEN 'tax_amount' END], lambda s: s IS NOT NULL)) AS field_name FROM p JOIN docs USING (doc_id)
UNION SELECT DISTINCT doc_id, unnest(list_filter([CASE WHEN units IS NULL THEN 'units' END, CASE WHEN unit_rate IS NULL THEN 'unit_rate' END], lambda s: s IS NOT NULL)) FROM p JOIN docs USING (doc_id) WHERE invoice_type_id IN ('VIAJES', 'EQUIPOS')
UNION SELECT doc_id, unnest(['net_amount', 'units']) FROM p JOIN docs USING (doc_id) WHERE invoice_type_id = 'EQUIPOS' AND net IS NULL""",
}
