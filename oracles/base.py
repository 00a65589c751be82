"""DuckDB SQL of the audit tables, written independently of the Spark code."""

from __future__ import annotations

from auditloom.plans import scenario


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, list):
        return "CAST([" + ", ".join(lit(v) for v in value) + "] AS VARCHAR[])"
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    body = ",\n  ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES\n  {body})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


RULES = values(
    "rules",
    "rule_id, invoice_type_id, rule_name, field_id, check_type, check_value, severity, agent_hint, "
    "error_message, page_region, rule_group, rule_order",
    scenario.rule_rows(),
)
FIELDS = values(
    "fields",
    "field_id, invoice_type_id, field_name, field_label, data_type, required, aliases, allowed_values",
    scenario.field_rows(),
)
DOCS = """docs AS (SELECT o_orderkey AS doc_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'VIAJES' WHEN '2-HIGH' THEN 'PERS_LOCAL' WHEN '3-MEDIUM' THEN 'PERS_SEDE'
    WHEN '4-NOT SPECIFIED' THEN 'EQUIPOS' WHEN '5-LOW' THEN 'CONSUMIBLES' END AS invoice_type_id,
  'doc-' || o_orderkey || '.pdf' AS invoice_file, o_custkey, o_orderstatus, o_orderdate,
  CAST(round(o_totalprice * 100) AS BIGINT) AS total_c FROM orders)"""
MEASURES = """measures AS (SELECT l_orderkey AS doc_id,
  (CAST(sum(net) AS BIGINT) + 50) // 100 AS net_c, (CAST(sum(net * tax) AS BIGINT) + 5000) // 10000 AS tax_c,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, max(tax) AS rate
  FROM (SELECT *, CAST(round(l_tax * 100) AS BIGINT) AS tax,
    CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS net FROM lineitem)
  GROUP BY l_orderkey)"""
WIDE = "wide AS (SELECT * FROM docs LEFT JOIN measures USING (doc_id))"


def european(c: str) -> str:
    return f"(replace(format('{{:,}}', ({c}) // 100), ',', '.') || ',' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"


def plain(c: str) -> str:
    return f"(CAST(({c}) // 100 AS VARCHAR) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0'))"


_TEXTS = [
    "CASE WHEN o_custkey % 17 = 0 THEN '' WHEN o_custkey % 19 = 0 THEN 'null' ELSE 'Customer#' || o_custkey END",
    "CASE WHEN doc_id % 11 <> 0 THEN 'INV-' || doc_id END",
    "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') "
    "WHEN doc_id % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y/%m/%d') END",
    "CASE o_orderstatus WHEN 'F' THEN 'EUR' WHEN 'O' THEN CASE WHEN doc_id % 2 = 0 THEN 'usd ' ELSE 'XAF' END END",
    european("net_c"),
    plain("tax_c"),
    f"CASE WHEN doc_id % 3 = 0 THEN {european('net_c + tax_c')} ELSE {european('total_c')} END",
    "CASE WHEN doc_id % 23 = 0 THEN '%%%' ELSE CAST(rate AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '%' ELSE '' END END",
    "CAST(units AS VARCHAR)",
    "CASE WHEN units IS NOT NULL THEN '8' END",
    plain("CASE WHEN doc_id % 4 = 0 THEN units * 800 WHEN doc_id % 4 = 1 THEN units * 8 ELSE units * 8 + 7 END"),
    "CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END",
]
FIELD_RESULTS = "field_results AS (\n" + "\nUNION ALL ".join(
    f"SELECT doc_id, invoice_type_id, '{f[0]}' AS field_id, '{f[1]}' AS field_name, {_TEXTS[i]} AS value_text, "
    f"((doc_id * 7 + {i * 13}) % 101) / 100.0::DOUBLE AS confidence, CAST(1 + (doc_id + {i}) % 3 AS INTEGER) AS source_page, "
    f"(doc_id + {i}) % 29 = 0 AS flagged_for_review FROM wide"
    for i, f in enumerate(scenario.FIELDS)
) + ")"
VERDICTS = """verdicts AS (SELECT d.doc_id, d.invoice_type_id, r.rule_id, r.rule_order,
  CAST(1 + d.doc_id % 4 AS INTEGER) AS page_num, l.quality = 1 AS passes,
  CASE WHEN l.toxic = 1 THEN NULL ELSE (d.doc_id % 10) / 10.0::DOUBLE END AS confidence,
  CASE WHEN d.doc_id % 5 <> 0 THEN 'Seen on page ' || (1 + d.doc_id % 4) END AS observation
  FROM docs d JOIN labels l USING (doc_id) JOIN rules r USING (invoice_type_id) WHERE r.check_type = 'visual_check')"""
ATTEMPTS = """attempts AS (SELECT l_orderkey AS doc_id, l_returnflag AS field_name,
  (CAST(l_linenumber AS BIGINT) * 268435456 + l_partkey) * 16777216 + l_suppkey AS seq,
  CASE WHEN NOT (l_linestatus = 'F' AND l_quantity < 10) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS value_text,
  l_discount * 10 AS confidence, l_linenumber AS source_page FROM lineitem)"""
RUN_LOG = """run_log AS (SELECT user_id AS run_id, event_id AS seq, ts, event_type AS tool, value, props,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def staged_number(source: str, text: str, out: str, tag: str) -> str:
    """CTEs turning ``text`` of relation ``source`` into the rule number ``out``.

    Adds relation ``tag`` = source plus column ``out``.
    """
    return f"""{tag}_1 AS (SELECT *, trim({text}, ' \t\n') AS _r FROM {source}),
{tag}_2 AS (SELECT *, trim(regexp_replace(regexp_replace(_r, '<[^>]+>', '', 'g'), '&nbsp;|&#160;| ', ' ', 'g')) AS _b FROM {tag}_1),
{tag}_3 AS (SELECT *, (starts_with(_b, '(') AND ends_with(_b, ')')) AS _n FROM {tag}_2),
{tag}_4 AS (SELECT *, regexp_extract(regexp_replace(regexp_replace(CASE WHEN _n THEN _b[2:-2] ELSE _b END, '[€$£ ]', '', 'g'), '%+$', ''), '[+-]?\\d[\\d.,]*') AS _t FROM {tag}_3),
{tag}_5 AS (SELECT *, length(_t) - length(replace(_t, ',', '')) AS _cc, length(_t) - length(replace(_t, '.', '')) AS _dd FROM {tag}_4),
{tag}_6 AS (SELECT *, CASE WHEN _cc > 0 AND _dd > 0 THEN replace(replace(_t, '.', ''), ',', '.') WHEN _cc = 1 THEN replace(_t, ',', '.')
  WHEN _cc > 1 THEN replace(_t, ',', '') WHEN _dd > 1 THEN replace(regexp_extract(_t, '^(.*)\\.[^.]*$', 1), '.', '') || '.' || regexp_extract(_t, '([^.]*)$', 1)
  ELSE _t END AS _p FROM {tag}_5),
{tag} AS (SELECT * EXCLUDE (_r, _b, _n, _t, _cc, _dd, _p), CASE WHEN lower(_r) NOT IN ('', 'null', 'none') AND lower(_b) NOT IN ('', 'null', 'none')
  AND regexp_matches(_p, '^[+-]?\\d+(\\.\\d*)?$') THEN CASE WHEN _n THEN -1 ELSE 1 END * TRY_CAST(_p AS DOUBLE) END AS {out} FROM {tag}_6)"""
