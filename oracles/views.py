from auditloom.plans import scenario

from .base import DOCS, RULES, with_
from .canonical import CANON, RUNS, SUMMARY

ACT = "normalized_status IN ('failed', 'flagged', 'warning', 'unknown')"


def _label(where: str = "true") -> str:
    return f"""lb AS (SELECT *, upper(left(b, 1)) || substr(b, 2) AS base FROM (SELECT *, replace(rule_name, '_', ' ') AS b FROM rules WHERE {where})),
lab AS (SELECT rule_id, CASE WHEN count(*) OVER (PARTITION BY lower(base)) > 1 THEN base || ' - ' || upper(left(field_id, 1)) || substr(replace(field_id, '_', ' '), 2) ELSE base END AS label, invoice_type_id FROM lb)"""


LAB = _label()
HAY = "lower(concat_ws(' ', label, rule_name, field_id, message, agent_notes))"
MISSING = "regexp_matches(lower(message || ' ' || agent_notes), 'missing|not identified|no se ha identificado|falta|null|required|obligatorio')"
TOPIC = f"CASE WHEN regexp_matches({HAY}, 'currency|moneda') THEN 'currency' WHEN regexp_matches({HAY}, 'total|amount|importe|gross|net') THEN 'amount' ELSE '' END"
_MISS = "list_filter([" + ", ".join(f"CASE WHEN {n} = '' THEN '{label}' END" for n, label in (
    ("vendor_name", "Vendor name"), ("vendor_vat_id", "Vendor VAT ID"), ("invoice_number", "Invoice number"), ("invoice_date", "Invoice date"),
    ("currency", "Currency"), ("gross_amount", "Gross amount"), ("net_amount", "Net amount"), ("tax_amount", "Tax amount"))) + "], lambda v: v IS NOT NULL)"
FACTS = f"""lr AS (SELECT cr.*, label, {ACT} AS act FROM cr JOIN lab USING (rule_id)),
ct AS (SELECT lr.*, CASE WHEN act AND {MISSING} THEN CASE WHEN {TOPIC} = 'currency' AND i.currency <> '' THEN 'Currency value exists but ' || label || ' still needs review'
  WHEN {TOPIC} = 'amount' AND ((regexp_matches({HAY}, 'net|base imponible') AND i.net_amount <> '') OR (regexp_matches({HAY}, 'tax|vat|iva|impuesto') AND i.tax_amount <> '')
    OR (regexp_matches({HAY}, 'gross|total|importe') AND i.gross_amount <> '')) THEN 'Amount value exists but ' || label || ' still needs review' END END AS contra
  FROM lr JOIN (SELECT invoice_id, currency, net_amount, tax_amount, gross_amount FROM inv) i USING (invoice_id)),
ag AS (SELECT invoice_id, coalesce(string_agg(DISTINCT label, '; ' ORDER BY label) FILTER (normalized_status IN ('failed', 'flagged')), '') AS bl,
  coalesce(string_agg(DISTINCT label, '; ' ORDER BY label) FILTER (normalized_status = 'warning'), '') AS wa,
  string_agg(label || ': ' || message, '; ' ORDER BY rule_id, message) FILTER (act) AS reasons,
  coalesce(list_sort(list(DISTINCT contra) FILTER (contra IS NOT NULL)), []) AS contras, lower(string_agg(concat_ws(' ', agent_notes, evidence_refs), ' ' ORDER BY rule_id) FILTER (act)) AS src,
  coalesce(string_agg(DISTINCT source_page, '; ' ORDER BY source_page) FILTER (act AND source_page <> ''), '') AS source_page,
  coalesce(string_agg(DISTINCT evidence_refs, '; ' ORDER BY evidence_refs) FILTER (act AND evidence_refs <> ''), '') AS evidence_refs,
  coalesce(string_agg(DISTINCT policy_refs, '; ' ORDER BY policy_refs) FILTER (act AND policy_refs <> ''), '') AS policy_refs FROM ct GROUP BY invoice_id),
fx AS (SELECT inv.* EXCLUDE (invoice_id), ag.*, {_MISS} AS miss,
  contras || CASE WHEN invoice_type_id = 'VIAJES' AND coalesce(regexp_matches(src, 'purchase|procurement|supplier|quotation|quote|bid|flour|wheat|goods|equipment|consumable|payment voucher')
    AND NOT regexp_matches(src, '(no (procurement|supplier|quotation|quote|bid|flour|wheat|goods|equipment|consumable|payment voucher))|((not|without) (procurement|supplier))|(sin (procurement|proveedor|cotizacion|cotización))'), false)
    THEN ['Invoice classified as travel but visible context suggests procurement or goods'] ELSE [] END AS clash
  FROM inv JOIN ag USING (invoice_id)),
fc AS (SELECT *, list_sort(clash) AS contra_list, array_to_string(miss, '; ') AS missing_txt, array_to_string(list_sort(clash), '; ') AS contra_txt,
  CASE WHEN web_view_link IS NOT NULL THEN web_view_link WHEN source_type = 'google_drive' THEN 'https://drive.google.com/file/d/' || source_id || '/view'
    WHEN starts_with(source_uri, 'file://') THEN source_uri ELSE '' END AS source_url FROM fx)"""
_PARTS = "concat_ws('; ', CASE WHEN bl <> '' THEN 'confirm ' || bl END, CASE WHEN wa <> '' THEN 'check ' || wa END, CASE WHEN len(miss) > 0 THEN 'complete missing fields: ' || missing_txt END, CASE WHEN len(clash) > 0 THEN 'resolve internal contradictions' END)"
ACTION = f"CASE WHEN bl <> '' OR len(clash) > 0 THEN 'Block approval until reviewed: ' || {_PARTS} || '.' WHEN wa <> '' THEN 'Check warning before approval: ' || {_PARTS} || '.' WHEN len(miss) > 0 THEN 'Complete missing invoice fields: ' || missing_txt || '.' ELSE 'No action needed.' END"
ATTN = "(review_status IN ('needs_review', 'warning', 'failed', 'error', 'unknown') OR bl <> '' OR wa <> '' OR len(miss) > 0 OR len(clash) > 0)"
PRIORITY = "CASE WHEN review_status IN ('error', 'failed', 'needs_review') OR bl <> '' OR len(clash) > 0 THEN '1' WHEN review_status = 'warning' OR wa <> '' THEN '2' WHEN review_status = 'unknown' OR len(miss) > 0 THEN '3' ELSE '4' END"


def policy(c: str) -> str:
    return (f"array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({c}, '; '), lambda t: CASE WHEN starts_with(t, '{{') THEN "
            f"coalesce(nullif(concat_ws(' - ', CASE WHEN NOT starts_with(json_extract_string(t, '$.snippet_id'), 'R_') THEN json_extract_string(t, '$.snippet_id') END, json_extract_string(t, '$.title'), json_extract_string(t, '$.source')), ''), 'Configured compliance rule') "
            f"ELSE regexp_replace(t, '(^| )R_[^ ]+', '\\1Configured compliance rule', 'g') END), lambda s: s <> ''))), '; ')")


VIEWS = (*CANON, LAB, FACTS)
_OBS = "('R_VIA_001')"
_GUIDE_ENTRIES = f"""ge AS (SELECT DISTINCT rule_id, CASE WHEN normalized_status = 'warning' THEN 'warning' ELSE 'failing' END AS kind, invoice_file AS entry, '' AS tie FROM cr WHERE normalized_status IN ('failed', 'flagged', 'warning')
UNION ALL SELECT rule_id, 'reasoning', invoice_file || ': ' || message, concat_ws(chr(1), invoice_file, normalized_status, message) FROM cr WHERE {ACT})"""
GUIDE = """gc AS (SELECT rule_id, count(*) FILTER (normalized_status = 'passed') AS passed, count(*) FILTER (normalized_status = 'failed') AS failed, count(*) FILTER (normalized_status = 'warning') AS warning,
  count(*) FILTER (normalized_status = 'flagged') AS flagged, count(*) FILTER (normalized_status = 'skipped') AS skipped, count(*) FILTER (normalized_status = 'unknown') AS unknown, count(*) AS total_results FROM cr GROUP BY rule_id),
guide AS (SELECT label AS rule, r.invoice_type_id AS invoice_type, severity, field_id AS field,
  CASE WHEN check_value <> '' THEN upper(left(check_type, 1)) || substr(replace(check_type, '_', ' '), 2) || ': ' || check_value ELSE upper(left(check_type, 1)) || substr(replace(check_type, '_', ' '), 2) END AS condition,
  agent_hint AS guidance, error_message AS failure_message, CAST(coalesce(passed, 0) AS VARCHAR) AS passed, CAST(coalesce(failed, 0) AS VARCHAR) AS failed, CAST(coalesce(warning, 0) AS VARCHAR) AS warning,
  CAST(coalesce(flagged, 0) AS VARCHAR) AS flagged, CAST(coalesce(skipped, 0) AS VARCHAR) AS skipped, CAST(coalesce(unknown, 0) AS VARCHAR) AS unknown, CAST(coalesce(total_results, 0) AS VARCHAR) AS total_results
  FROM rules r JOIN lab USING (rule_id) LEFT JOIN gc USING (rule_id))"""
_MATRIX_LABELS = {}
for _row in scenario.rule_rows():
    _name = _row[2].replace("_", " ")
    _base = _name[0].upper() + _name[1:]
    _MATRIX_LABELS.setdefault((_row[2], _row[3], _base), set()).add(_row[1])


def _matrix() -> str:
    cols = []
    for (name, field, base), types in _MATRIX_LABELS.items():
        label = f"{base} - {field.replace('_', ' ')}" if len(types) > 1 else base
        alias = label.lower().replace(" - ", "_").replace(" ", "_")
        inside = ", ".join(f"'{t}'" for t in sorted(types))
        cols.append(f"coalesce(max(cr.normalized_status) FILTER (cr.rule_name = '{name}'), CASE WHEN inv.invoice_type_id IN ({inside}) THEN 'not_checked' ELSE 'not_applicable' END) AS {alias}")
    return "SELECT inv.invoice_file, inv.invoice_type_id AS invoice_type, inv.review_status, " + ",\n".join(cols) + " FROM inv LEFT JOIN cr ON cr.invoice_id = inv.invoice_id GROUP BY inv.invoice_id, ALL"


SQL = {
    "compliance_matrix": with_(*CANON) + _matrix().replace("GROUP BY inv.invoice_id, ALL", "GROUP BY inv.invoice_id, inv.invoice_file, inv.invoice_type_id, inv.review_status"),
    "compliance_matrix_long": with_(*CANON, LAB) + """SELECT inv.invoice_id, lab.rule_id, label, coalesce(cr.normalized_status, CASE WHEN lab.invoice_type_id <> inv.invoice_type_id THEN 'not_applicable' ELSE 'not_checked' END) AS status
FROM inv CROSS JOIN lab LEFT JOIN cr ON cr.invoice_id = inv.invoice_id AND cr.rule_id = lab.rule_id""",
    "matrix_missing_status": with_(DOCS) + "SELECT doc_id, t AS rule_type, CASE WHEN t <> '' AND t <> invoice_type_id THEN 'not_applicable' ELSE 'not_checked' END AS status FROM docs, (SELECT unnest(['VIAJES', 'PERS_LOCAL', 'PERS_SEDE', 'EQUIPOS', 'CONSUMIBLES', '']) AS t)",
    "reject_ambiguous": with_(*CANON) + "SELECT invoice_id, rule_id, normalized_status AS status FROM cr",
    "invoice_review_summary": with_(*VIEWS) + f"""SELECT invoice_file, invoice_type_id AS invoice_type, review_status, {ACTION} AS primary_action, vendor_name, vendor_vat_id, invoice_number, invoice_date, currency, gross_amount, net_amount, tax_amount,
missing_txt AS missing_critical_fields, contra_txt AS contradictions, bl AS blocking_rules, wa AS warning_rules, '0' AS not_checked_count FROM fc""",
    "review_queue": with_(*VIEWS) + f"""SELECT {PRIORITY} AS priority, {ACTION} AS recommended_action, '' AS decision, '' AS reviewer, '' AS notes, '' AS resolved_date, invoice_file, invoice_type_id AS invoice_type, review_status, bl AS blocking_rules, wa AS warning_rules,
concat_ws('; ', CASE WHEN review_status <> 'passed' THEN 'review_status=' || review_status END, reasons, CASE WHEN len(miss) > 0 THEN 'Missing critical fields: ' || missing_txt END, CASE WHEN len(clash) > 0 THEN 'Internal contradictions: ' || contra_txt END) AS review_reasons,
missing_txt AS missing_critical_fields, contra_txt AS contradictions, source_page, evidence_refs, {policy('policy_refs')} AS policy_summary, source_url, source_uri FROM fc WHERE {ATTN}""",
    "review_issues": with_(*VIEWS) + f"""SELECT CASE WHEN normalized_status = 'warning' THEN '2' ELSE '1' END AS priority, CASE WHEN normalized_status = 'warning' THEN 'warning_rule' ELSE 'blocking_rule' END AS issue_type, severity,
CASE WHEN normalized_status = 'warning' THEN 'Check warning before approval: check ' || label || '.' ELSE 'Block approval until reviewed: confirm ' || label || '.' END AS recommended_action, '' AS decision, '' AS notes, '' AS resolved_date,
lr.invoice_file, lr.invoice_type_id AS invoice_type, review_status, field_id AS field, label AS rule, CASE WHEN message = '' THEN normalized_status ELSE message END AS issue, lr.source_page, lr.evidence_refs, {policy('lr.policy_refs')} AS policy_summary, source_url, source_uri FROM lr JOIN fc USING (invoice_id) WHERE act
UNION ALL SELECT '3', 'missing_critical_field', 'warning', 'Complete missing invoice field: ' || m || '.', '', '', '', invoice_file, invoice_type_id, review_status, m, '', 'Missing critical field: ' || m, '', '', '', source_url, source_uri FROM (SELECT *, unnest(miss) AS m FROM fc)
UNION ALL SELECT '1', 'internal_contradiction', 'error', 'Block approval until reviewed: resolve internal contradiction.', '', '', '', invoice_file, invoice_type_id, review_status, '', '', c, '', '', '', source_url, source_uri FROM (SELECT *, unnest(clash) AS c FROM fc)""",
    "dashboard": with_(*VIEWS) + """SELECT section, metric, value, CAST(count(*) AS VARCHAR) AS count FROM (
SELECT 'Action summary' AS section, 'Invoices' AS metric, CASE WHEN len(clash) > 0 OR review_status IN ('needs_review', 'failed', 'error') THEN 'Blocked / needs review' WHEN review_status = 'warning' THEN 'Warnings' WHEN review_status = 'passed' THEN 'Passed' ELSE 'Unknown' END AS value FROM fc
UNION ALL SELECT 'Invoice review', 'Review status', review_status FROM fc UNION ALL SELECT 'Compliance status', 'Rule results', normalized_status FROM cr
UNION ALL SELECT 'Missing critical fields', 'Field', unnest(miss) FROM fc UNION ALL SELECT 'Internal contradictions', 'Finding', unnest(clash) FROM fc
UNION ALL SELECT 'Rules needing attention', 'Rule', label FROM lr WHERE act) GROUP BY ALL
UNION ALL SELECT * FROM (VALUES ('Legend', 'Status', 'not_checked', ''), ('Legend', 'Status', 'not_applicable', ''), ('Legend', 'Issue', 'internal_contradiction', ''))""",
    "rule_guide": with_(*CANON, LAB, GUIDE) + "SELECT * FROM guide",
    "rule_guide_entries": with_(*CANON, _GUIDE_ENTRIES) + "SELECT rule_id, kind, entry FROM ge",
    "status_pivot": with_(*CANON) + "SELECT rule_name, normalized_status, count(invoice_id) AS invoices, CAST(GROUPING(rule_name) * 2 + GROUPING(normalized_status) AS INTEGER) AS level FROM cr GROUP BY CUBE (rule_name, normalized_status)",
    "matrix_column_notes": with_(*CANON, LAB, GUIDE) + "SELECT rule AS label, concat_ws(chr(10), nullif(severity, ''), nullif(condition, ''), nullif(guidance, ''), nullif(failure_message, '')) AS note FROM guide",
    "rule_labels": with_(RULES, LAB) + "SELECT rule_id, label FROM lab",
    "missing_critical_fields": with_(*SUMMARY) + f"SELECT invoice_id, array_to_string({_MISS}, '; ') AS missing FROM inv",
    "action_rows": with_(*CANON) + f"SELECT rule_id, count(*) AS rows FROM cr WHERE {ACT} GROUP BY rule_id",
    "needs_attention": with_(*VIEWS) + f"SELECT invoice_id, {ATTN} AS needs_attention FROM fc",
    "source_url": with_(DOCS, RUNS) + "SELECT doc_id, CASE WHEN web_view_link IS NOT NULL THEN web_view_link WHEN source_type = 'google_drive' THEN 'https://drive.google.com/file/d/' || source_id || '/view' ELSE source_uri END AS source_url FROM runs",
    "policy_summary": with_(*CANON) + f"SELECT invoice_id, rule_id, {policy('policy_refs')} AS policy_summary FROM cr",
    "rule_topic": with_(*CANON, LAB) + f"""SELECT invoice_id, rule_id, {TOPIC} AS topic, concat_ws('|', CASE WHEN regexp_matches({HAY}, 'net|base imponible') THEN 'net_amount' END, CASE WHEN regexp_matches({HAY}, 'tax|vat|iva|impuesto') THEN 'tax_amount' END,
CASE WHEN regexp_matches({HAY}, 'gross|total|importe') THEN 'total_amount|gross_amount' END) AS amount_fields, {MISSING} AS looks_missing FROM cr JOIN lab USING (rule_id)""".replace("cr JOIN lab USING (rule_id)", "(SELECT cr.*, label FROM cr JOIN lab USING (rule_id))"),
    "contradictions": with_(*VIEWS) + "SELECT invoice_id, unnest(clash) AS contradiction FROM fc",
    "recommended_action": with_(*VIEWS) + f"SELECT invoice_id, {ACTION} AS recommended_action FROM fc",
    "review_priority": with_(*VIEWS) + f"SELECT {PRIORITY} AS priority, review_status, count(*) AS invoices FROM fc WHERE {ATTN} GROUP BY ALL",
}
