from .base import with_

MD = """md0 AS (SELECT doc_id AS file_id, unnest(string_split(regexp_replace(text, '[ \\t\\r\\f]+', ' ', 'g'), chr(10))) AS t0, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
md1 AS (SELECT file_id, i, trim(t0) AS t, last_value(CASE WHEN i % 9 = 0 THEN 'TYPE' || (i % 4) END IGNORE NULLS) OVER w AS ty, last_value(CASE WHEN i % 9 = 1 THEN 'cat' || (i % 5) END IGNORE NULLS) OVER w AS ca FROM md0 WINDOW w AS (PARTITION BY file_id ORDER BY i))"""
STORE = """st AS (SELECT CAST(item_id + 1 AS INTEGER) AS learning_id, ['GENERAL', 'VIAJES', 'PERS_LOCAL', 'PERS_SEDE', 'EQUIPOS'][1 + item_id % 5] AS invoice_type_id, ['approaches', 'vision_model_extraction', 'common_failures'][1 + item_id % 3] AS category, text AS content FROM benchmark)"""
NEW = """nw0 AS (SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]+ *')) AS content, generate_subscripts(regexp_split_to_array(text, '[.\\n]+ *'), 1) - 1 AS pos FROM benchmark),
nw AS (SELECT item_id * 1000 + pos AS new_id, trim(content) AS content FROM nw0 WHERE trim(content) <> ''),
cn AS (SELECT DISTINCT new_id FROM nw WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(lower(d.text), lower(nw.content))))"""


def fmt(n: str) -> str:
    return f"'L' || CASE WHEN length(CAST({n} AS VARCHAR)) < 3 THEN lpad(CAST({n} AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END"


SQL = {
    "parse_learnings": with_(MD) + """SELECT file_id, CASE WHEN i % 9 >= 4 THEN CAST(i AS INTEGER) END AS learning_id, ty AS invoice_type_id, ca AS category, CASE WHEN i % 9 >= 4 THEN '2024-01-02' END AS entry_date, CASE WHEN i % 9 = 4 THEN '2024-02-03' END AS edited_date,
md5(CASE WHEN i % 9 = 2 THEN trim('plain ' || t) ELSE t END) AS content FROM md1 WHERE i % 9 = 2 OR i % 9 >= 4""",
    "read_learnings": with_(STORE) + "SELECT learning_id, invoice_type_id, category FROM st WHERE invoice_type_id IN ('GENERAL', 'VIAJES')",
    "contained_learnings": with_(NEW) + "SELECT new_id FROM cn",
    "insert_learnings": with_(NEW, "fr AS (SELECT * FROM nw WHERE new_id NOT IN (SELECT new_id FROM cn) AND NOT EXISTS (SELECT 1 FROM nw o WHERE o.new_id < nw.new_id AND contains(lower(o.content), lower(nw.content))))",
                              "nu AS (SELECT content, CAST((SELECT max(doc_id) FROM documents) + row_number() OVER (ORDER BY new_id) AS INTEGER) AS learning_id FROM fr)")
    + f"SELECT learning_id, {fmt('learning_id')} AS label, '2024-05-05' AS entry_date, md5(content) AS digest FROM nu",
    "edit_learnings": with_(STORE) + "SELECT learning_id, '2024-01-01' AS entry_date, CASE WHEN learning_id % 4 = 1 AND learning_id IN (SELECT item_id FROM benchmark) THEN '2024-06-06' END AS edited_date, md5(CASE WHEN learning_id % 4 = 1 AND learning_id IN (SELECT item_id FROM benchmark) THEN 'new ' || learning_id ELSE content END) AS digest FROM st",
    "delete_learnings": with_(STORE) + "SELECT learning_id FROM st WHERE learning_id NOT IN (SELECT item_id FROM benchmark WHERE item_id % 3 = 0)",
    "reset_learnings": with_(STORE) + "SELECT learning_id, CASE WHEN invoice_type_id = 'VIAJES' AND category = 'approaches' THEN 'removed' ELSE 'kept' END AS side FROM st",
    "vision_hints": with_(STORE) + "SELECT min(learning_id) AS learning_id, md5(arg_min(trim(content), learning_id)) AS digest FROM st WHERE category = 'vision_model_extraction' GROUP BY lower(trim(content))",
    "first_occurrence": "SELECT min(event_id) AS event_id, event_type || ':' || user_id AS what FROM events GROUP BY 2",
    "carry_heading": "WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM documents) SELECT doc_id, line_no, last_value(CASE WHEN length(line) % 5 = 0 THEN md5(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading FROM a",
    "next_learning_id": f"SELECT event_id, {fmt('n')} AS learning_id FROM (SELECT event_id, 41 + row_number() OVER (ORDER BY event_id) AS n FROM events)",
}
