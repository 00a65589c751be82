from .base import with_

TYPES = "ty AS (SELECT 'T' || c_custkey AS invoice_type_id, c_name AS display_name, c_mktsegment AS description, 'ctx' AS agent_context FROM customer WHERE c_custkey % 4 <> 0)"
ALLOWED = """al0 AS (SELECT replace(p_name, ' ', '_') AS field_name, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'T' || (p_partkey % (SELECT count(*) FROM customer)) END AS invoice_type_id, CASE WHEN p_partkey % 20 = 0 THEN '' ELSE p_brand END AS value, min(p_partkey) AS line_no FROM part GROUP BY ALL),
al AS (SELECT field_name, invoice_type_id, string_agg(value, '|' ORDER BY line_no, value) AS allowed_values FROM al0 WHERE value <> '' GROUP BY ALL)"""
FIELDS = """fl AS (SELECT 'F' || p_partkey AS field_id, 'T' || (p_partkey % (SELECT count(*) FROM customer)) AS invoice_type_id, replace(p_name, ' ', '_') AS field_name, p_partkey % 3 = 0 AS required, p_brand || '|' || p_type AS aliases FROM part WHERE 'T' || (p_partkey % (SELECT count(*) FROM customer)) IN (SELECT invoice_type_id FROM ty))"""
RULES = """ru AS (SELECT 'R_' || o_orderkey AS rule_id, 'T' || o_custkey AS invoice_type_id, '' AS check_value, CASE WHEN o_orderkey % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN o_orderkey % 3 = 0 THEN 'grants' ELSE 'general' END AS rule_group
  FROM orders WHERE o_orderkey % 6 <> 0 AND 'T' || o_custkey IN (SELECT invoice_type_id FROM ty))"""
REFS = """rf AS (SELECT o_custkey AS folder, ['compliance_rules.csv', 'extraction_fields.csv', 'invoice_types.csv', 'allowed_values.csv', 'employee_name_role_denylist.txt', 'ground_truth.csv', 'notes.md'][1 + o_orderkey % 7] AS name, 'id' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS id,
  CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE o_orderstatus END AS rev FROM orders)"""
_MANIFEST = """mf AS (SELECT CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'id' || o_orderkey END AS id, 'Doc ' || o_orderkey || '.pdf' AS name, o_orderkey AS k, o_orderdate FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)"""
SQL = {
    "load_doc_types": with_(TYPES) + "SELECT * FROM ty",
    "load_allowed_values": with_(ALLOWED) + "SELECT * FROM al",
    "load_fields": with_(TYPES, ALLOWED, FIELDS) + """SELECT f.field_id, f.invoice_type_id, required, aliases, coalesce(a.allowed_values, b.allowed_values, '') AS allowed_values FROM fl f LEFT JOIN al a ON a.field_name = f.field_name AND a.invoice_type_id = f.invoice_type_id
LEFT JOIN al b ON b.field_name = f.field_name AND b.invoice_type_id = ''""",
    "load_rules": with_(TYPES, RULES) + "SELECT * FROM ru",
    "filter_rule_groups": with_(TYPES, RULES) + "SELECT rule_id, rule_group FROM ru WHERE rule_group = 'grants'",
    "rules_for_type": with_(TYPES, RULES) + "SELECT rule_id FROM ru WHERE invoice_type_id = 'T7'",
    "rules_for_present_types": with_(TYPES, RULES) + "SELECT rule_id, invoice_type_id FROM ru WHERE invoice_type_id IN (SELECT 'T' || c_custkey FROM customer WHERE c_acctbal < 0)",
    "extraction_schema": with_(TYPES, FIELDS) + "SELECT invoice_type_id, string_agg(field_name, '|' ORDER BY field_name) AS names, CAST(count(*) FILTER (required) AS INTEGER) AS required FROM (SELECT * FROM fl QUALIFY row_number() OVER (PARTITION BY invoice_type_id, field_name ORDER BY field_id) = 1) GROUP BY 1",
    "load_denylist": "SELECT lower(role || ' A') AS phrase FROM conversations UNION ALL SELECT CAST(conv_id AS VARCHAR) FROM conversations",
    "scan_remote_manifest": with_(_MANIFEST) + """SELECT name AS display_name, 'gdrive://' || id AS uri, id AS source_id, CASE WHEN k % 4 = 0 THEN 'h' || k WHEN k % 2 = 0 THEN md5(CAST(k AS VARCHAR)) ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS revision_id, CASE WHEN k % 3 <> 0 THEN k * 10 END AS size_bytes,
CAST(epoch(o_orderdate) AS BIGINT) AS modified, 'https://v/' || k AS link FROM mf WHERE id <> ''""",
    "manifest_rejects": with_(_MANIFEST) + "SELECT name FROM mf WHERE id = ''",
    "exclude_outputs": "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN '/output/' ELSE '/in/' END || page_id AS uri FROM pages WHERE page_id % 3 <> 0",
    "validate_config_set": with_(REFS, "cnt AS (SELECT folder, name, count(*) AS n FROM rf WHERE name <> 'notes.md' GROUP BY ALL)") + """SELECT f.folder, coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM cnt WHERE cnt.folder = f.folder AND n > 1), '') AS duplicates,
concat_ws('|', CASE WHEN NOT EXISTS (SELECT 1 FROM cnt WHERE cnt.folder = f.folder AND name = 'compliance_rules.csv') THEN 'compliance_rules.csv' END, CASE WHEN NOT EXISTS (SELECT 1 FROM cnt WHERE cnt.folder = f.folder AND name = 'extraction_fields.csv') THEN 'extraction_fields.csv' END,
CASE WHEN NOT EXISTS (SELECT 1 FROM cnt WHERE cnt.folder = f.folder AND name = 'invoice_types.csv') THEN 'invoice_types.csv' END) AS missing FROM (SELECT DISTINCT folder FROM rf) f""",
    "config_fingerprint": with_(REFS, "ln AS (SELECT folder, name, min(name || ':' || id || ':' || rev) AS l FROM rf WHERE name <> 'notes.md' GROUP BY ALL)") + "SELECT folder, left(sha256(string_agg(l, chr(10) ORDER BY name)), 12) AS fingerprint FROM ln GROUP BY folder",
}
