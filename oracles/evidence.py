from .base import DOCS, FIELDS, RULES, european, plain, staged_number, with_
from .rules import RESULTS
from .scalar import AMOUNT_RE, DATE_RE, REF_RE, TERMS

PAGES = f"""pg AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_num, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS price_c, max(l_partkey) AS part FROM lineitem GROUP BY ALL),
pages_ AS (SELECT doc_id, page_num, price_c, part, ['INVOICE_HEADER','LINE_ITEMS','TOTALS','SIGNATURE_STAMP','SUPPORTING_DOC','COVER_PAGE','BLANK','UNKNOWN'][1 + (doc_id + page_num) % 8] AS category,
  ['Invoice','Receipt of bank transfer','Nomina','Stamp','Annex'][1 + part % 5] || ' total ' || {european('price_c')} || ' fee ' || {plain('((doc_id % 90) * 100 + CASE WHEN part % 3 = 0 THEN page_num * 2 ELSE page_num * 700 END)')}
  || CASE WHEN part % 2 = 0 THEN ' ref AB-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 4, '1') ELSE '' END
  || CASE WHEN part % 5 < 3 THEN ' on ' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') || '/05/2024' ELSE ' on 2024-05-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') END AS description FROM pg)"""
FACTS = "\n,".join(["pages_x AS (SELECT doc_id, page_num, unnest(regexp_extract_all(description, '" + AMOUNT_RE + "')) AS m FROM pages_)",
                    staged_number("pages_x", "m", "v", "pv")]) + f""",
pam AS (SELECT doc_id, page_num, list(DISTINCT round(v, 2)) AS amounts FROM pv WHERE v IS NOT NULL GROUP BY ALL),
pf AS (SELECT p.*, coalesce(amounts, []) AS amounts, list_sort(list_distinct(regexp_extract_all(description, '{DATE_RE}'))) AS dates, list_sort(list_distinct(regexp_extract_all(description, '{REF_RE}'))) AS refs,
  list_sort(list_filter({TERMS}, lambda t: contains(lower(description), t))) AS markers FROM pages_ p LEFT JOIN pam USING (doc_id, page_num))"""
LINKS = """hd AS (SELECT * FROM pf WHERE category = 'INVOICE_HEADER' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_num) = 1),
lk0 AS (SELECT s.doc_id, h.page_num AS invoice_page, s.page_num AS supporting_page,
  len(list_filter(h.amounts, lambda a: len(list_filter(s.amounts, lambda b: abs(a - b) <= 0.02::DOUBLE)) > 0)) > 0 AS amount_match,
  len(list_intersect(list_transform(h.dates, lambda d: CASE WHEN d[3] = '/' THEN d[7:10] || '-' || d[4:5] || '-' || d[1:2] ELSE d END), list_transform(s.dates, lambda d: CASE WHEN d[3] = '/' THEN d[7:10] || '-' || d[4:5] || '-' || d[1:2] ELSE d END))) > 0 AS date_match,
  len(list_intersect(list_transform(h.refs, lambda r: lower(r)), list_transform(s.refs, lambda r: lower(r)))) > 0 AS reference_match, len(s.markers) > 0 AS has_payment_marker
  FROM pf s JOIN hd h ON h.doc_id = s.doc_id AND h.page_num <> s.page_num),
lk AS (SELECT *, CAST(amount_match AS INTEGER) + CAST(date_match AS INTEGER) + CAST(reference_match AS INTEGER) AS matched_signals FROM lk0)"""
LINKED = (PAGES, FACTS, LINKS)
TARGETS = "tg AS (SELECT doc_id, invoice_type_id, CAST(1 + doc_id % 7 AS INTEGER) AS page_num FROM docs)"
REQ = "CASE WHEN regexp_matches(lower(rule_name || ' ' || check_value), 'proof_of_payment|justificante|payment') THEN ['receipt_page_candidate','payment_indicator','invoice_receipt_link'] WHEN check_type = 'visual_check' THEN ['visual_observation'] ELSE ['field_values'] END"
SLOTS = f"""pe AS (SELECT doc_id, bool_or(matched_signals >= 2) AS any_link, bool_or(has_payment_marker) AS any_marker FROM lk GROUP BY doc_id),
s1 AS (SELECT r.doc_id, r.rule_id, r.rule_order, r.severity, r.check_type, r.status, {REQ.replace('rule_name', 'u.rule_name').replace('check_value', 'u.check_value').replace('check_type', 'u.check_type')} AS req, any_link, any_marker, pe.doc_id IS NOT NULL AS sup,
  r.status IN ('passed', 'failed') AS done, r.check_type = 'visual_check' AS vis FROM res r JOIN rules u ON u.rule_id = r.rule_id LEFT JOIN pe ON pe.doc_id = r.doc_id),
s2 AS (SELECT *, list_filter([CASE WHEN done AND NOT vis AND req[1] = 'field_values' THEN 'field_values' END, CASE WHEN done AND vis AND len(req) = 3 AND any_link THEN 'invoice_receipt_link' END,
  CASE WHEN done AND vis AND len(req) = 3 AND any_marker THEN 'payment_indicator' END, CASE WHEN done AND vis AND len(req) = 3 AND sup THEN 'receipt_page_candidate' END,
  CASE WHEN done AND vis AND req[1] = 'visual_observation' THEN 'visual_observation' END], lambda s: s IS NOT NULL) AS filled FROM s1),
sl AS (SELECT *, list_filter(req, lambda s: NOT list_contains(filled, s)) AS missing FROM s2)"""
_CATS = "wc AS (SELECT invoice_type_id, CASE WHEN invoice_type_id IN ('VIAJES', 'CONSUMIBLES') THEN ['INVOICE_HEADER','SIGNATURE_STAMP','SUPPORTING_DOC','TOTALS'] ELSE ['INVOICE_HEADER','SIGNATURE_STAMP'] END AS cats FROM (SELECT DISTINCT invoice_type_id FROM docs))"
OCR = f"""o0 AS (SELECT doc_id, page_num AS n, price_c, part, unnest([0, 1, 2]) AS i FROM pages_),
ocr AS (SELECT o0.doc_id, 1 AS page_num, n * 3 + i AS line_no, CASE i WHEN 1 THEN {european('price_c')} WHEN 2 THEN 'note ' || part ELSE
  CASE n WHEN 1 THEN 'Net amount: ' || {european('price_c')} WHEN 2 THEN 'Tax amount' WHEN 3 THEN 'Gross Total' WHEN 4 THEN 'Invoice Date : ' || (1 + part % 28) WHEN 5 THEN 'VAT rate:' WHEN 6 THEN 'Véndor name ' || part ELSE 'Importe' END END AS text,
  ((o0.doc_id + n * 3 + i) * 7) % 100 / 100.0::DOUBLE AS confidence, CAST(50 + (part % 5) * 60 + CASE WHEN i = 2 THEN 400 ELSE 0 END AS INTEGER) AS x1, n * 90 + i * 28 AS y1,
  CAST(50 + (part % 5) * 60 + CASE WHEN i = 2 THEN 400 ELSE 0 END + 120 + i * 40 AS INTEGER) AS x2, n * 90 + i * 28 + 20 AS y2, invoice_type_id FROM o0 JOIN docs USING (doc_id)),
terms AS (SELECT DISTINCT invoice_type_id, field_name, lower(t) AS term FROM (SELECT invoice_type_id, field_name, unnest([field_label] || aliases) AS t FROM fields) WHERE length(trim(t)) >= 3),
hit AS (SELECT ocr.*, field_name, length(term) / CAST(length(text) AS DOUBLE) AS score FROM ocr JOIN terms USING (invoice_type_id) WHERE contains(replace(lower(text), 'é', 'e'), term)),
lbl AS (SELECT * FROM hit WHERE score >= 0.15::DOUBLE QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY score DESC, line_no) = 1),
blw AS (SELECT l.doc_id, l.field_name, v.line_no AS vno, v.text AS vtext, v.confidence AS vconf, v.x1 AS vx1, v.x2 AS vx2, v.y2 AS vy2 FROM lbl l JOIN ocr v ON v.doc_id = l.doc_id
  AND v.y1 > l.y2 AND v.y1 <= l.y2 + greatest(l.y2 - l.y1, 1) * 2.5 AND least(v.x2, l.x2) - greatest(v.x1, l.x1) >= (l.x2 - l.x1) * 0.2::DOUBLE QUALIFY row_number() OVER (PARTITION BY l.doc_id, l.field_name ORDER BY v.y1, v.line_no) = 1),
loc0 AS (SELECT l.*, vno, vtext, vconf, vx1, vx2, vy2, trim(regexp_extract(text, '^[^:]*:(.*)$', 1)) AS after FROM lbl l LEFT JOIN blw b USING (doc_id, field_name)),
loc AS (SELECT doc_id, page_num, field_name, line_no, CASE WHEN after <> '' THEN after WHEN vno IS NOT NULL THEN vtext END AS value_text, CASE WHEN after <> '' THEN confidence WHEN vno IS NOT NULL THEN vconf ELSE 0.0::DOUBLE END AS value_confidence,
  CAST(greatest(0, CASE WHEN after = '' AND vno IS NOT NULL THEN least(x1, vx1) ELSE x1 END - 9) AS INTEGER) AS x1, CAST(greatest(0, y1 - 6) AS INTEGER) AS y1,
  CAST(least(600, CASE WHEN after <> '' THEN x2 WHEN vno IS NOT NULL THEN greatest(x2, vx2) ELSE x2 + CAST(floor((x2 - x1) * 1.5::DOUBLE) AS INTEGER) END + 9) AS INTEGER) AS x2,
  CAST(least(800, CASE WHEN after <> '' THEN y2 WHEN vno IS NOT NULL THEN vy2 ELSE y2 + 60 END + 6) AS INTEGER) AS y2 FROM loc0),
box AS (SELECT doc_id, page_num, CASE WHEN ends_with(field_name, 'amount') THEN 'totals' ELSE 'body' END AS region, greatest(0, min(x1) - 12) AS x1, greatest(0, min(y1) - 16) AS y1, least(600, max(x2) + 12) AS x2, least(800, max(y2) + 16) AS y2 FROM loc GROUP BY ALL)"""
LAYOUT = (FIELDS, DOCS, PAGES, OCR)
_TYPE5 = "['GENERAL','VIAJES','PERS_LOCAL','PERS_SEDE','EQUIPOS']"
LEARN = f"""ln AS (SELECT {_TYPE5}[1 + item_id % 5] AS scope, item_id AS line_no, '- [L' || lpad(CAST(item_id AS VARCHAR), 3, '0') || '] [2024-01-01] ' || regexp_replace(text, '\\s+', ' ', 'g')
  || CASE item_id % 3 WHEN 0 THEN ' see R_' || ['VIA','PL','PS','EQ','CO'][1 + item_id % 5] || '_00' || (1 + item_id % 9) WHEN 1 THEN ' about currency and VENDOR stamp' ELSE '' END AS text FROM benchmark)"""

SQL = {
    "page_facts": with_(PAGES, FACTS) + """SELECT doc_id, page_num, category, CASE WHEN regexp_matches(lower(description), 'payroll|nomina') THEN 'payroll' WHEN regexp_matches(lower(description), 'invoice|factura') THEN 'invoice' WHEN regexp_matches(lower(description), 'receipt|justificante') THEN 'receipt' WHEN regexp_matches(lower(description), 'stamp|seal') THEN 'stamp_page' ELSE 'unknown' END AS doc_subtype,
CAST(len(amounts) AS INTEGER) AS n_amounts, array_to_string(dates, '|') AS dates, array_to_string(refs, '|') AS refs, array_to_string(markers, '|') AS markers, 0.6::DOUBLE AS confidence FROM pf""",
    "link_pages": with_(*LINKED) + "SELECT doc_id, invoice_page, supporting_page, matched_signals >= 2 AS linked, amount_match, date_match, reference_match, matched_signals, has_payment_marker FROM lk",
    "required_slots": with_(RULES, DOCS) + f"SELECT doc_id, rule_id, array_to_string({REQ}, '|') AS slots FROM docs JOIN rules USING (invoice_type_id)",
    "evidence_slots": with_(*RESULTS, *LINKED, SLOTS) + "SELECT doc_id, rule_id, array_to_string(req, '|') AS required_slots, array_to_string(filled, '|') AS filled_slots, array_to_string(missing, '|') AS missing_slots FROM sl",
    "evidence_gaps": with_(*RESULTS, *LINKED, SLOTS) + "SELECT doc_id, rule_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY rule_order) AS INTEGER) AS rank, array_to_string(missing, '|') AS missing_slots FROM sl WHERE severity = 'error' AND len(missing) > 0",
    "evidence_pages": with_(DOCS, PAGES, TARGETS, _CATS) + """SELECT p.doc_id, p.page_num, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY CASE WHEN p.page_num = t.page_num THEN 0 WHEN list_contains(cats, category) THEN 1 ELSE 2 END, p.page_num) AS INTEGER) AS position
FROM pages_ p JOIN tg t USING (doc_id) JOIN wc USING (invoice_type_id) WHERE p.page_num = t.page_num OR list_contains(cats, category) OR p.page_num = 1""",
    "signature_page": with_(DOCS, PAGES, TARGETS) + """SELECT t.doc_id, t.page_num AS asked_page, CASE WHEN s.stamp IS NOT NULL AND coalesce(p.category, '') NOT IN ('INVOICE_HEADER', 'SIGNATURE_STAMP') THEN s.stamp ELSE t.page_num END AS page_num
FROM tg t LEFT JOIN pages_ p ON p.doc_id = t.doc_id AND p.page_num = t.page_num LEFT JOIN (SELECT doc_id, min(page_num) AS stamp FROM pages_ WHERE category = 'SIGNATURE_STAMP' GROUP BY doc_id) s ON s.doc_id = t.doc_id""",
    "category_union": with_(DOCS, _CATS) + "SELECT invoice_type_id, array_to_string(cats, '|') AS categories, count(*) AS documents FROM docs JOIN wc USING (invoice_type_id) GROUP BY ALL",
    "page_batches": with_(PAGES) + "SELECT doc_id, page_num, CAST((page_num - 1) // 5 AS INTEGER) AS batch_no, CAST((page_num - 1) % 5 AS INTEGER) AS position FROM pages_",
    "batch_answers": with_(PAGES) + "SELECT doc_id, page_num, CASE WHEN (doc_id + page_num) % 4 > 0 THEN category ELSE 'UNKNOWN' END AS category, CASE WHEN (doc_id + page_num) % 4 > 0 THEN description ELSE '(no response)' END AS description FROM pages_",
    "inventory_todo": with_(PAGES) + "SELECT doc_id, count(*) AS page_count FROM pages_ WHERE doc_id % 3 = 0 GROUP BY doc_id",
    "policy_refs": with_(RULES, LEARN, """kw AS (SELECT rule_id, list_distinct(list_filter(regexp_extract_all(lower(agent_hint || ' ' || rule_name || ' ' || field_id || ' ' || check_type), '[a-z0-9_]+'), lambda w: length(w) >= 3)) AS ws, invoice_type_id FROM rules),
pr AS (SELECT kw.rule_id, line_no, text, CASE WHEN scope = 'GENERAL' THEN 0 ELSE 1 END AS part, regexp_matches(text, '\\b' || kw.rule_id || '\\b') AS direct, len(list_filter(ws, lambda w: contains(lower(text), w))) AS score FROM kw JOIN ln ON scope = 'GENERAL' OR scope = invoice_type_id),
d AS (SELECT rule_id, text, row_number() OVER (PARTITION BY rule_id ORDER BY part, line_no) AS rk FROM pr WHERE direct QUALIFY rk <= 3),
i AS (SELECT rule_id, text, row_number() OVER (PARTITION BY rule_id ORDER BY score DESC, part, line_no) AS rk FROM pr WHERE score > 0 AND rule_id NOT IN (SELECT rule_id FROM d) QUALIFY rk <= 2),
f AS (SELECT * FROM d UNION ALL SELECT * FROM i)""") + "SELECT r.rule_id, CAST(coalesce(rk, 1) AS INTEGER) AS rank, CASE WHEN text IS NULL THEN 'compliance_rules' ELSE 'learnings' END AS source, coalesce(regexp_extract(text, '^- \\[(L\\d+)\\]', 1), r.rule_id) AS snippet_id, text AS snippet FROM rules r LEFT JOIN f USING (rule_id)",
    "localize_labels": with_(*LAYOUT) + "SELECT doc_id, page_num, field_name, line_no, text, score FROM lbl",
    "localize_values": with_(*LAYOUT) + "SELECT * FROM loc",
    "value_below_label": with_(*LAYOUT) + "SELECT doc_id, 1 AS page_num, field_name, vno AS line_no, vtext AS text FROM blw",
    "route_extraction": with_(*LAYOUT) + """SELECT f.field_name, CASE WHEN loc.doc_id IS NULL THEN 'fallback' WHEN value_confidence >= 0.8::DOUBLE AND coalesce(value_text, '') <> '' THEN 'ocr_direct' ELSE 'ocr_crop' END AS route, count(*) AS fields
FROM docs d JOIN fields f USING (invoice_type_id) LEFT JOIN loc ON loc.doc_id = d.doc_id AND loc.field_name = f.field_name GROUP BY ALL""",
    "union_boxes": with_(*LAYOUT) + "SELECT doc_id, page_num, region, x1, y1, x2, y2 FROM box",
    "lines_in_crop": with_(*LAYOUT) + "SELECT b.doc_id, b.page_num, region, line_no, text FROM box b JOIN ocr o ON o.doc_id = b.doc_id AND o.x1 < b.x2 AND o.x2 > b.x1 AND o.y1 < b.y2 AND o.y2 > b.y1",
    "full_text": "SELECT doc_id, md5(string_agg(t, chr(10) ORDER BY i)) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(t) <> '' GROUP BY ALL",
}
