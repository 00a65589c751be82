from .base import DOCS, FIELD_RESULTS, FIELDS, MEASURES, RULES, WIDE, european, plain, with_
from .rules import EVALUATED
from .scalar import norm_date, score_stages

FR = (DOCS, MEASURES, WIDE, FIELD_RESULTS)
TRUTH = f"""wt AS (SELECT doc_id, invoice_type_id, CASE o_custkey % 3 WHEN 0 THEN ' customer#' || o_custkey || ' ' WHEN 1 THEN 'the Customer#' || o_custkey ELSE 'zz' END AS vendor_name, 'INV-' || doc_id AS invoice_number,
  strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, CASE WHEN doc_id % 5 > 0 THEN 'EUR' ELSE ' ' END AS currency, {plain('net_c + CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END')} AS net_amount, {european('tax_c')} AS tax_amount,
  rate || CASE WHEN doc_id % 9 = 0 THEN '.001' ELSE '' END AS vat_rate, 'bank' AS payment_method, CASE WHEN doc_id % 2 = 0 THEN '2024' ELSE 'May 2024' END AS pay_period FROM wide),
truth AS (SELECT doc_id, invoice_type_id, field_name, trim(truth_value) AS truth_value FROM (UNPIVOT wt ON vendor_name, invoice_number, invoice_date, currency, net_amount, tax_amount, vat_rate, payment_method, pay_period INTO NAME field_name VALUE truth_value) WHERE trim(truth_value) <> '')"""
EXTRACTED = """ex AS (SELECT doc_id, field_name, value_text FROM field_results
UNION ALL SELECT doc_id, 'payment_method', CASE WHEN doc_id % 4 = 0 THEN '12/05' ELSE 'Bank transfer' END FROM docs
UNION ALL SELECT doc_id, 'pay_period', ['5', '05/2024 y 2024', '2023', 'may 2024', '2024', 'x'][1 + doc_id % 6] FROM docs)"""
_ABS = "abs(en - tn)"
COMPARE = "\n,".join(["pr0 AS (SELECT coalesce(ex.doc_id, truth.doc_id) AS doc_id, coalesce(ex.field_name, truth.field_name) AS field_name, value_text, truth_value FROM ex FULL JOIN truth ON ex.doc_id = truth.doc_id AND ex.field_name = truth.field_name)",
                      score_stages("pr0", "value_text", "en", "pr1"), score_stages("pr1", "truth_value", "tn", "pr2"),
                      f"pr3 AS (SELECT *, lower(trim(coalesce(value_text, ''))) AS e, lower(trim(coalesce(truth_value, ''))) AS t, {norm_date('trim(value_text)')} AS ed, {norm_date('trim(truth_value)')} AS td FROM pr2)",
                      "pr4 AS (SELECT *, e = t AS ex_, e <> t AND e <> '' AND t <> '' AND (contains(e, t) OR contains(t, e)) AS pa_ FROM pr3)",
                      f"""cmp AS (SELECT doc_id, field_name, value_text, truth_value, CASE WHEN truth_value IS NULL THEN NULL
  WHEN value_text IS NULL OR lower(value_text) IN ('', 'null', 'none') THEN false
  WHEN field_name = 'pay_period' THEN CASE WHEN en BETWEEN 1 AND 12 AND tn BETWEEN 1900 AND 2100 THEN false WHEN en BETWEEN 1900 AND 2100 AND tn BETWEEN 1900 AND 2100 THEN {_ABS} <= 0.02::DOUBLE
    WHEN ed = td THEN true WHEN contains(value_text, '2024') AND contains(truth_value, '2024') THEN true ELSE ex_ END
  WHEN field_name <> 'invoice_date' AND en IS NOT NULL AND tn IS NOT NULL THEN {_ABS} <= CASE WHEN contains(field_name, 'rate') THEN 0.001::DOUBLE ELSE 0.02::DOUBLE END
  WHEN field_name = 'invoice_date' THEN ed = td WHEN field_name = 'payment_method' AND value_text = '12/05' THEN false ELSE ex_ END AS match,
CASE WHEN truth_value IS NULL THEN 'no ground truth provided for this field' WHEN value_text IS NULL OR lower(value_text) IN ('', 'null', 'none') THEN 'field not extracted'
  WHEN field_name = 'pay_period' THEN CASE WHEN en BETWEEN 1 AND 12 AND tn BETWEEN 1900 AND 2100 THEN 'extracted looks like month number only; truth is a year — use MM/YYYY or text (e.g. Août 2025) in extraction and CSV'
    WHEN en BETWEEN 1900 AND 2100 AND tn BETWEEN 1900 AND 2100 THEN CASE WHEN {_ABS} <= 0.02::DOUBLE THEN '' ELSE printf('year diff: %.4f', {_ABS}) END
    WHEN ed = td THEN '' WHEN contains(value_text, '2024') AND contains(truth_value, '2024') THEN 'same calendar year in both values' WHEN pa_ THEN 'partial match' WHEN ex_ THEN '' ELSE 'mismatch' END
  WHEN field_name <> 'invoice_date' AND en IS NOT NULL AND tn IS NOT NULL THEN printf('numeric diff: %.4f', {_ABS})
  WHEN field_name = 'invoice_date' THEN CASE WHEN ed = td THEN '' ELSE 'date mismatch: ''' || ed || ''' vs ''' || td || '''' END
  WHEN field_name = 'payment_method' AND value_text = '12/05' THEN 'extracted looks like a date fragment — use payer line or bank/cash wording' WHEN pa_ THEN 'partial match' WHEN ex_ THEN '' ELSE 'mismatch' END AS note FROM pr4),
cm AS MATERIALIZED (SELECT *, note = 'partial match' AS partial, CASE WHEN match IS NULL THEN NULL WHEN match THEN 'exact' WHEN note = 'partial match' THEN 'partial' WHEN note = 'field not extracted' THEN 'not_extracted' ELSE 'wrong_value' END AS o FROM cmp)"""])
COMPARED = (*FR, TRUTH, EXTRACTED, COMPARE)
SCORES = """sc AS MATERIALIZED (SELECT doc_id, count(*) FILTER (o = 'exact') AS fields_exact, count(*) FILTER (o = 'partial') AS fields_partial, count(*) FILTER (o = 'not_extracted') AS fields_not_extracted, count(*) FILTER (o = 'wrong_value') AS fields_wrong_value, count(o) AS fields_total FROM cm GROUP BY doc_id)"""
TRULES = "tr AS (SELECT doc_id, rule_id, CASE (doc_id + rule_order) % 3 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE '' END AS truth_status FROM docs JOIN rules USING (invoice_type_id))"
RSCORE = "rs AS MATERIALIZED (SELECT tr.doc_id, count(*) FILTER (status = truth_status) AS rules_correct, count(*) AS rules_total FROM tr LEFT JOIN e0 ON e0.doc_id = tr.doc_id AND e0.rule_id = tr.rule_id WHERE truth_status <> '' GROUP BY tr.doc_id)"
FILES = """tf AS (SELECT p_partkey AS line_no, CASE WHEN p_partkey % 10 = 0 THEN 'gd' || p_partkey END AS source_id, CASE WHEN p_partkey % 20 = 0 THEN CAST(p_partkey % 5 AS VARCHAR) END AS revision_id,
  CASE WHEN p_partkey % 50 = 2 THEN p_type ELSE p_name || ' ' || p_brand END AS source_name FROM part),
nd AS (SELECT l_orderkey AS doc_id, 'gd' || p_partkey AS source_id, CAST(l_orderkey % 5 AS VARCHAR) AS revision_id, CASE l_orderkey % 3 WHEN 0 THEN p_name || '-' || p_brand || '-' || l_orderkey WHEN 1 THEN p_type || ' ' || p_name ELSE p_brand END AS nm
  FROM (SELECT l_orderkey, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1) JOIN part USING (p_partkey)),
tk AS (SELECT line_no, source_id, revision_id, regexp_replace(lower(source_name), '[^a-z0-9]+', '', 'g') AS k FROM tf), dk AS (SELECT DISTINCT regexp_replace(lower(nm), '[^a-z0-9]+', '', 'g') AS k FROM nd)"""


def _by_name(only: str = "true") -> str:
    return f"kk AS (SELECT dk.k, min(line_no) AS line_no FROM dk JOIN (SELECT k, min(line_no) AS line_no FROM tk WHERE {only} GROUP BY k) t ON contains(dk.k, t.k) OR contains(t.k, dk.k) GROUP BY dk.k), bn AS (SELECT doc_id, line_no FROM nd JOIN kk ON kk.k = regexp_replace(lower(nm), '[^a-z0-9]+', '', 'g'))"


_BY_SOURCE = "bs AS (SELECT doc_id, min(line_no) AS line_no FROM nd JOIN tf ON nd.source_id = tf.source_id AND (tf.revision_id IS NULL OR tf.revision_id = nd.revision_id) GROUP BY doc_id)"
SQL = {
    "fold_any_script": "SELECT conv_id, turn, md5(strip_accents(lower(text))) AS digest FROM conversations",
    "truth_unpivot": with_(*FR[:3], TRUTH) + "SELECT doc_id, field_name, truth_value FROM truth",
    "truth_schema_filter": with_(FIELDS, *FR[:3], TRUTH) + "SELECT field_name, count(*) AS rows FROM truth t WHERE EXISTS (SELECT 1 FROM fields f WHERE f.invoice_type_id = t.invoice_type_id AND f.field_name = t.field_name) GROUP BY 1",
    "compare_value": with_(*COMPARED) + "SELECT doc_id, field_name, match, partial, note FROM cm",
    "extraction_full_outer_truth": with_(*COMPARED) + "SELECT field_name, CASE WHEN value_text IS NULL AND truth_value IS NULL THEN 'neither' WHEN value_text IS NULL THEN 'truth' WHEN truth_value IS NULL THEN 'extracted' ELSE 'both' END AS side, count(*) AS fields FROM cm GROUP BY ALL",
    "rule_accuracy": with_(*EVALUATED, TRULES, RSCORE) + "SELECT doc_id, rules_correct, rules_total, round(rules_correct / rules_total, 4) AS rule_accuracy FROM rs",
    "score_documents": with_(RULES, FIELDS, *COMPARED, SCORES, *EVALUATED[6:], TRULES, RSCORE)
    + """SELECT d.doc_id, d.invoice_type_id, fields_exact, fields_partial, fields_not_extracted, fields_wrong_value, fields_total, fields_not_extracted + fields_wrong_value AS fields_wrong, fields_exact + fields_partial AS fields_correct,
round((fields_exact + fields_partial) / fields_total, 4) AS field_accuracy, round(fields_exact / fields_total, 4) AS exact_accuracy, coalesce(rules_correct, 0) AS rules_correct, coalesce(rules_total, 0) AS rules_total, round(rules_correct / rules_total, 4) AS rule_accuracy,
CASE d.doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN d.invoice_type_id = 'VIAJES' ELSE true END AS type_correct FROM docs d LEFT JOIN sc USING (doc_id) LEFT JOIN rs USING (doc_id)""",
    "batch_accuracy": with_(*COMPARED, SCORES) + """SELECT invoice_file AS filename, invoice_type_id AS invoice_type, CAST(fields_total AS VARCHAR) AS fields_total, CAST(fields_exact AS VARCHAR) AS fields_exact, CAST(fields_partial AS VARCHAR) AS fields_partial, CAST(fields_not_extracted + fields_wrong_value AS VARCHAR) AS fields_wrong,
printf('%.1f', round((fields_exact + fields_partial) / fields_total, 4) * 100) AS field_accuracy_pct, printf('%.1f', round(fields_exact / fields_total, 4) * 100) AS exact_accuracy_pct FROM docs JOIN sc USING (doc_id)
UNION ALL SELECT 'TOTALS', '(' || count(*) || ' scored)', CAST(sum(fields_total) AS VARCHAR), CAST(sum(fields_exact) AS VARCHAR), CAST(sum(fields_partial) AS VARCHAR), CAST(sum(fields_not_extracted + fields_wrong_value) AS VARCHAR),
printf('%.1f', round(sum(fields_exact + fields_partial) / sum(fields_total), 4) * 100), printf('%.1f', round(sum(fields_exact) / sum(fields_total), 4) * 100) FROM sc""",
    "field_accuracy": with_(*COMPARED) + "SELECT field_name, count(o) AS compared, count(*) FILTER (o = 'exact') AS exact, count(*) FILTER (o = 'partial') AS partial, count(*) FILTER (o IN ('not_extracted', 'wrong_value')) AS wrong, round(count(*) FILTER (o = 'exact') / count(o), 4) AS strict FROM cm GROUP BY field_name HAVING count(o) > 0",
    "match_truth_by_name": with_(FILES, _by_name()) + "SELECT * FROM bn",
    "match_truth_by_source": with_(FILES, _BY_SOURCE) + "SELECT * FROM bs",
    "match_truth": with_(FILES, _by_name("source_id IS NULL"), _BY_SOURCE) + "SELECT doc_id, min(line_no) AS line_no FROM (SELECT * FROM bn UNION ALL SELECT * FROM bs) GROUP BY doc_id",
    "resolve_truth_table": with_(DOCS) + "SELECT doc_id, CASE invoice_type_id WHEN 'VIAJES' THEN 'truth_urgent' WHEN 'PERS_LOCAL' THEN 'truth_high' ELSE 'truth_all' END AS table_name FROM docs",
    "json_over_csv_truth": with_(*FR[:3], TRUTH) + """SELECT doc_id, unnest(['vendor_name', 'units']) AS field_name, unnest(['J' || doc_id, '3']) AS truth_value FROM docs WHERE doc_id % 3 <> 0 AND doc_id % 4 = 1
UNION ALL SELECT doc_id, field_name, truth_value FROM truth WHERE NOT (doc_id % 3 <> 0 AND doc_id % 4 = 1)""",
}
