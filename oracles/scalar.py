from .base import european, plain, staged_number, with_

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
C = "CAST(round(l_extendedprice * 100) AS BIGINT)"
_US = f"(format('{{:,}}', {C} // 100) || '.' || lpad(CAST({C} % 100 AS VARCHAR), 2, '0'))"
AMOUNTS = f"""amounts AS (SELECT {LINE}, CASE l_partkey % 10 WHEN 0 THEN {european(C)} WHEN 1 THEN {_US}
  WHEN 2 THEN '(' || {plain(C)} || ')' WHEN 3 THEN ' € ' || {european(C)} WHEN 4 THEN '<td>' || {plain(C)} || '</td>%'
  WHEN 5 THEN 'Total: ' || {plain(C)} || ' EUR' WHEN 6 THEN '%%%' WHEN 7 THEN CAST(l_quantity AS INTEGER) || ',5'
  WHEN 8 THEN '1.2,3,' || l_linenumber ELSE 'null' END AS text FROM lineitem)"""
DATES = f"""dates AS (SELECT {LINE}, CASE l_partkey % 7 WHEN 0 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN strftime(l_shipdate, '%d/%m/%Y')
  WHEN 2 THEN strftime(l_shipdate, '%-m.%-d.%Y') WHEN 3 THEN strftime(l_shipdate, '%Y/%-m/%-d') WHEN 4 THEN strftime(l_shipdate, 'Q1 %Y')
  WHEN 5 THEN strftime(l_shipdate, '%-d-%-m-%y') ELSE '' END AS text FROM lineitem)"""


def rightmost(t: str) -> str:
    cc = f"(length({t}) - length(replace({t}, ',', '')))"
    dd = f"(length({t}) - length(replace({t}, '.', '')))"
    return (f"CASE WHEN {cc} > 0 AND {dd} > 0 THEN CASE WHEN regexp_matches({t}, ',[^.]*$') THEN replace(replace({t}, '.', ''), ',', '.') "
            f"ELSE replace({t}, ',', '') END WHEN {cc} = 1 THEN replace({t}, ',', '.') WHEN {cc} > 1 THEN replace({t}, ',', '') "
            f"WHEN {dd} > 1 THEN replace(regexp_extract({t}, '^(.*)\\.[^.]*$', 1), '.', '') || '.' || regexp_extract({t}, '([^.]*)$', 1) ELSE {t} END")


def score_stages(source: str, text: str, out: str, tag: str) -> str:
    return f"""{tag}_1 AS (SELECT *, trim({text}, ' \t\n') AS _r FROM {source}),
{tag}_2 AS (SELECT *, regexp_replace(_r, '[ €$£%]', '', 'g') AS _b FROM {tag}_1),
{tag}_3 AS (SELECT *, regexp_extract({rightmost('_b')}, '[+-]?\\d[\\d.,]*') AS _t FROM {tag}_2),
{tag}_4 AS (SELECT *, {rightmost('_t')} AS _p FROM {tag}_3),
{tag} AS (SELECT * EXCLUDE (_r, _b, _t, _p), CASE WHEN lower(_r) NOT IN ('', 'null', 'none') AND regexp_matches(_p, '^[+-]?\\d+(\\.\\d*)?$')
  THEN TRY_CAST(_p AS DOUBLE) END AS {out} FROM {tag}_4)"""


YF = "^(\\d{4})[/.\\-](\\d{1,2})[/.\\-](\\d{1,2})$"
YP = "^(\\d{4})[/.\\-](\\d{2})[/.\\-](\\d{2})$"
YL = "^(\\d{1,2})[/.\\-](\\d{1,2})[/.\\-](\\d{4})$"


def norm_date(t: str, mdy: bool = False) -> str:
    a, b, y = (f"regexp_extract({t}, '{YL}', {i})" for i in (1, 2, 3))
    ia, ib = f"TRY_CAST({a} AS INTEGER)", f"TRY_CAST({b} AS INTEGER)"
    swap = f"({ia} <= 12 AND ({ib} > 12 OR {'true' if mdy else 'false'}))"
    m, d = f"CASE WHEN {swap} THEN {a} ELSE {b} END", f"CASE WHEN {swap} THEN {b} ELSE {a} END"
    return (f"CASE WHEN {t} = '' THEN NULL WHEN regexp_matches({t}, '{YF}') THEN regexp_extract({t}, '{YF}', 1) || '-' || "
            f"lpad(regexp_extract({t}, '{YF}', 2), 2, '0') || '-' || lpad(regexp_extract({t}, '{YF}', 3), 2, '0') "
            f"WHEN regexp_matches({t}, '{YL}') AND TRY_CAST({m} AS INTEGER) BETWEEN 1 AND 12 AND TRY_CAST({d} AS INTEGER) BETWEEN 1 AND 31 "
            f"THEN {y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') ELSE lower({t}) END")


def date_token(t: str) -> str:
    return (f"CASE WHEN regexp_matches({t}, '{YL}') THEN regexp_extract({t}, '{YL}', 3) || '-' || lpad(regexp_extract({t}, '{YL}', 2), 2, '0') "
            f"|| '-' || lpad(regexp_extract({t}, '{YL}', 1), 2, '0') WHEN regexp_matches({t}, '{YP}') THEN replace(replace({t}, '/', '-'), '.', '-') "
            f"ELSE lower({t}) END")


def stem(name: str) -> str:
    s = f"trim(regexp_replace(lower(regexp_replace({name}, '([^/])\\.[^./]+$', '\\1')), '[^a-z0-9]+', '-', 'g'), '-')"
    return f"coalesce(nullif(rtrim(left({s}, 64), '-'), ''), 'document')"


_TOTAL = "CAST(round(o_totalprice * 100) AS BIGINT)"
DESC = f"""descr AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'Invoice total ' WHEN 1 THEN 'Nómina importe ' WHEN 2 THEN 'Bank RECEIPT over '
  WHEN 3 THEN 'stamped page ' WHEN 4 THEN 'Factura por ' ELSE 'Annex ' END || {european(_TOTAL)} || ' EUR ref INV-' || o_orderkey || '/AB2024 on '
  || strftime(o_orderdate, '%d/%m/%Y') || ', due ' || strftime(o_orderdate, '%Y-%m-%d') || '; fee ' || {plain('o_orderkey % 1000')}
  || CASE WHEN o_orderkey % 4 = 0 THEN ' paid by card' ELSE '' END AS description FROM orders)"""
AMOUNT_RE = "\\b\\d{1,3}(?:[.,]\\d{3})*(?:[.,]\\d{2})\\b|\\b\\d+[.,]\\d{2}\\b"
DATE_RE = "\\b\\d{1,2}[/.\\-]\\d{1,2}[/.\\-]\\d{2,4}\\b|\\b\\d{4}[/.\\-]\\d{2}[/.\\-]\\d{2}\\b"
REF_RE = "\\b[A-Z]{1,5}[-_/]?\\d{2,}\\b"
TERMS = "['transfer','bank','iban','swift','paid','payment','tarjeta','card','receipt','justificante']"
OBS = """obs AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'The Employee  name ''' || c_name || ''' is clear; Paid by bank transfer, ok'
  WHEN 1 THEN 'name ''' || c_mktsegment || ''' and payment method: cash (signed)' WHEN 2 THEN 'employee name ''Supplier Liaison''. Pagado por caja; fin'
  WHEN 3 THEN 'name ''ab''' WHEN 4 THEN 'Payé par la banque, page 2' ELSE 'nothing seen' END AS observation FROM customer)"""
_NAME = "trim(coalesce(nullif(regexp_extract(observation, '(?i)employee\\s+name\\s+''([^'']+)''', 1), ''), nullif(regexp_extract(observation, '(?i)name\\s+''([^'']+)''', 1), '')))"
NAME = f"CASE WHEN NOT (length({_NAME}) < 3 OR lower({_NAME}) IN ('supplier liaison', 'community manager') OR ((contains(lower({_NAME}), 'supplier liaison') OR contains(lower({_NAME}), 'community manager')) AND length({_NAME}) < 35)) THEN {_NAME} END"
PAY = "trim(coalesce(nullif(regexp_extract(observation, '(?i)(Payé par[^,.;)]*)', 1), ''), nullif(regexp_extract(observation, '(?i)(Paid by[^,.;)]*)', 1), ''), nullif(regexp_extract(observation, '(?i)(pagado por[^,.;)]*)', 1), ''), nullif(regexp_extract(observation, '(?i)(payment method[^,.;)]*)', 1), '')))"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = {
    "normalize_numeric": with_(AMOUNTS, staged_number("amounts", "text", "number", "n")) + "SELECT * FROM n",
    "normalize_number_eval": with_(AMOUNTS, score_stages("amounts", "text", "number", "n")) + "SELECT * FROM n",
    "normalize_date": with_(DATES) + f"SELECT *, {norm_date('text')} AS dmy, {norm_date('text', True)} AS mdy FROM dates",
    "normalize_date_token": with_(DATES) + f"SELECT *, {date_token('text')} AS token, regexp_matches(text, '^\\d{{1,2}}[/.\\-]\\d{{1,2}}([/.\\-]\\d{{2,4}})?$') AS is_fragment FROM dates",
    "normalize_text": f"SELECT doc_id, md5(lower(trim(chr(9) || text || chr(10), {WS}))) AS digest FROM documents",
    "sanitize_text": f"""WITH t AS (SELECT page_id, trim(replace(replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&#\\d+;', ' ', 'g'), '&nbsp;', ' '), chr(160), ' '), {WS}) AS c FROM pages),
u AS (SELECT page_id, CASE WHEN lower(c) NOT IN ('', 'null', 'none') THEN c END AS c FROM t) SELECT page_id, CAST(length(c) AS INTEGER) AS n_chars, md5(c) AS digest FROM u""",
    "snap_enum": """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN lower(replace(o_orderpriority, ' ', '-')) WHEN 1 THEN '  ' || lower(o_orderpriority) ELSE '6-NONE' END AS raw FROM orders)
SELECT o_orderkey, raw, list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda v: regexp_replace(lower(v), '[\\s\\-]+', '_', 'g') = regexp_replace(lower(trim(raw)), '[\\s\\-]+', '_', 'g'))[1] AS snapped FROM t""",
    "match_key": "SELECT page_id, regexp_replace(lower('A.5.d.- ' || url), '[^a-z0-9]+', '', 'g') AS match_key FROM pages",
    "safe_stem": "SELECT item_id, " + stem("(replace(text, '/', ' ') || '.pdf')") + " AS stem FROM benchmark",
    "source_hash": """SELECT o_orderkey, left(sha256('local:/in/' || o_orderkey || '.pdf:' || CAST(epoch(o_orderdate) AS BIGINT) || ':' || o_custkey), 12) AS local_hash,
left(sha256('google_drive:' || o_orderkey || ':' || CASE WHEN o_custkey % 3 > 0 THEN o_orderpriority ELSE 'unknown' END), 12) AS drive_hash FROM orders""",
    "run_id": "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S%fZ') || '-run-' || user_id || '-' || left(sha256(event_type), 12) AS run_id FROM events",
    "dedup_key": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE 'file:///' || o_orderkey END || '#' || CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus ELSE 'norev' END AS dedup_key FROM orders",
    "revision_of": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'head-' || o_orderkey WHEN o_orderkey % 2 = 0 THEN md5(CAST(o_orderkey AS VARCHAR)) ELSE strftime(o_orderdate, '%Y-%m-%d') END AS revision FROM orders",
    "extract_entities": with_(DESC, f"hits AS (SELECT o_orderkey, unnest(regexp_extract_all(description, '{AMOUNT_RE}')) AS m FROM descr)",
                              staged_number("hits", "m", "v", "nums"),
                              "am AS (SELECT o_orderkey, count(DISTINCT round(v, 2)) AS n, min(round(v, 2)) AS lo, max(round(v, 2)) AS hi FROM nums GROUP BY 1)")
    + f"""SELECT d.o_orderkey, CAST(n AS INTEGER) AS n_amounts, lo AS least, hi AS most,
array_to_string(list_sort(list_distinct(regexp_extract_all(description, '{DATE_RE}'))), '|') AS dates,
array_to_string(list_sort(list_distinct(regexp_extract_all(description, '{REF_RE}'))), '|') AS refs,
array_to_string(list_sort(list_filter({TERMS}, lambda t: contains(lower(description), t))), '|') AS markers FROM descr d JOIN am USING (o_orderkey)""",
    "doc_subtype": with_(DESC) + """SELECT o_orderkey, CASE WHEN regexp_matches(lower(description), 'payroll|nomina|nómina') THEN 'payroll' WHEN regexp_matches(lower(description), 'invoice|factura') THEN 'invoice'
WHEN regexp_matches(lower(description), 'receipt|justificante') THEN 'receipt' WHEN regexp_matches(lower(description), 'stamp|seal') THEN 'stamp_page' ELSE 'unknown' END AS subtype FROM descr""",
    "normalize_category": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'UNKNOWN' ELSE upper(p_type) END AS category FROM part",
    "target_categories": """WITH t AS (SELECT p_partkey, p_name || ' ' || ['payment','translated','supplier quote','seal','total','budget language'][p_partkey % 6 + 1] AS s FROM part),
u AS (SELECT p_partkey, ['INVOICE_HEADER'] || CASE WHEN regexp_matches(s, 'payment|proof|justificante|receipt|bank') THEN ['SIGNATURE_STAMP','SUPPORTING_DOC','TOTALS'] ELSE [] END
 || CASE WHEN regexp_matches(s, 'translation|translated|idioma|language') THEN ['SUPPORTING_DOC','COVER_PAGE'] ELSE [] END
 || CASE WHEN regexp_matches(s, 'quote|presupuesto|budget|supplier') THEN ['SUPPORTING_DOC','LINE_ITEMS'] ELSE [] END
 || CASE WHEN regexp_matches(s, 'stamp|seal|signature|signed') THEN ['SIGNATURE_STAMP'] ELSE [] END AS c FROM t)
SELECT p_partkey, array_to_string(list_sort(list_distinct(c)), '|') AS categories FROM u""",
    "display_text": """WITH t AS (SELECT p_partkey, trim(regexp_replace(replace(p_name, ' ', '_') || '--' || lower(p_brand), '[_\\s\\-]+', ' ', 'g')) AS s FROM part)
SELECT p_partkey, upper(left(s, 1)) || substr(s, 2) AS label FROM t""",
    "keyword_set": """WITH t AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')), lambda w: length(w) >= 3 AND w NOT IN ('true','false','none')) AS ws FROM documents)
SELECT doc_id, md5(array_to_string(list_sort(ws), ' ')) AS digest, CAST(len(ws) AS INTEGER) AS n_words FROM t""",
    "parse_employee_name": with_(OBS) + f"SELECT *, {NAME} AS employee_name FROM obs",
    "parse_payment_phrase": with_(OBS) + f"SELECT *, {PAY} AS payment FROM obs",
    "observation_rows": with_(OBS, "w(t, rule_id, target_field, k) AS (VALUES ('2-HIGH', 'R_PL_010', 'employee_name', 1), ('2-HIGH', 'R_PL_010', 'payment_method', 2), ('1-URGENT', 'R_VIA_011', 'payment_method', 2))")
    + f"SELECT * FROM (SELECT o_orderkey AS doc_id, rule_id, target_field, CASE WHEN k = 1 THEN {NAME} ELSE {PAY} END AS value FROM orders JOIN obs ON o_custkey = c_custkey JOIN w ON t = o_orderpriority) WHERE value IS NOT NULL",
    "fold_accents": "SELECT doc_id, md5(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüýÿñç', 'aaaaaaeeeeiiiiooooouuuuyync')) AS digest FROM documents",
    "clamp_confidence": "SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN least(greatest(c_acctbal / 5000, 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.5::DOUBLE END AS confidence FROM customer",
    "clean_updates": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'kind|note|vendor' ELSE 'kind|vendor' END AS names, c_name AS vendor, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS note FROM customer",
    "parse_iso_utc": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 1 THEN CAST(floor(epoch(ts)) AS BIGINT) - 7200 WHEN 2 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS epoch FROM events",
    "size_mb": "SELECT page_id, round(length(html) * 1000 / 1048576.0::DOUBLE, 2) AS size_mb, round(length(html) * 1000 / 1048576.0::DOUBLE, 2) > 8 AS suggest_compression FROM pages",
}
