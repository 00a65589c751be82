from .base import RUN_LOG, with_
from .rules import RESULTS

LOG = """lg AS (SELECT run_id, seq, CASE tool WHEN 'view' THEN 'extract_fields_vision' WHEN 'click' THEN 'crop_region' WHEN 'signup' THEN 'check_compliance' WHEN 'purchase' THEN 'note' ELSE 'inspect_file' END AS tool,
  tool AS ev, tool <> 'error' OR k % 2 = 0 AS success, CAST(floor(value) AS BIGINT) AS tokens, k * 10 AS elapsed_ms, CASE WHEN tool IN ('view', 'signup') THEN 'chat' ELSE 'generate' END AS kind, k % 2 AS result_hash,
  tool = 'view' AND k % 9 = 0 AS updates, k, CASE k % 4 WHEN 3 THEN '' WHEN 2 THEN '2, 3' ELSE '1' END AS page, CASE WHEN k % 4 = 2 THEN '["a","b"]' END AS fields,
  row_number() OVER (PARTITION BY user_.run_id ORDER BY seq) - 1 AS turn FROM run_log user_)"""
BASE = (RUN_LOG, LOG)
W = "(PARTITION BY run_id ORDER BY seq"
_STREAK = f"""a AS (SELECT *, CASE WHEN tool <> 'check_compliance' THEN tool || page || coalesce(fields, '') END AS sig FROM lg),
b AS (SELECT *, coalesce(sig = last_value(sig IGNORE NULLS) OVER {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS rep FROM a),
c AS (SELECT *, turn - max(CASE WHEN NOT rep THEN turn END) OVER {W}) AS streak FROM b)"""
_FAIL = f"""a AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, tool ORDER BY seq) AS island FROM lg),
b AS (SELECT *, sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, tool, island ORDER BY seq) AS failures FROM a),
t AS (SELECT DISTINCT tool AS t FROM lg)"""
_TOTAL = "tot AS (SELECT run_id, seq, " + " + ".join(
    f"coalesce(last_value(CASE WHEN tool = '{t}' THEN failures END IGNORE NULLS) OVER {W}), 0)"
    for t in ("extract_fields_vision", "crop_region", "check_compliance", "note", "inspect_file")) + " AS total FROM b)"
_SAME = f"""a AS (SELECT *, lag(result_hash) OVER {W}) AS ph, lag(turn) OVER {W}) AS pt FROM lg WHERE tool = 'check_compliance'),
b AS (SELECT lg.run_id, lg.seq, lg.turn, lg.tool, lg.updates, a.pt, coalesce(a.result_hash = a.ph, false) AS same FROM lg LEFT JOIN a USING (run_id, seq)),
c AS (SELECT *, sum(CASE WHEN updates OR (tool = 'check_compliance' AND NOT same) THEN 1 ELSE 0 END) OVER {W}) AS g FROM b),
d AS (SELECT *, CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, g ORDER BY seq) AS BIGINT) AS s FROM c)"""
_WORK = """wk AS (SELECT doc_id, doc_id % 11 > 0 AS typed, doc_id % 2 = 0 AS compressed, doc_id % 4 = 0 AS inventory, doc_id % 3 > 0 AS results, doc_id % 5 > 1 AS full_q, bool_or(coalesce(skip_kind = 'visual', false)) AS pending, doc_id % 7 > 0 AS fields_ FROM res GROUP BY doc_id)"""

SQL = {
    "canonical_params": with_(*BASE) + "SELECT seq, nullif(page, '') AS page, fields, CASE page WHEN '2, 3' THEN 2 ELSE 1 END AS page_no FROM lg",
    "validate_actions": with_(*BASE) + """SELECT seq, CASE WHEN tool = 'extract_fields_vision' THEN CASE k % 4 WHEN 0 THEN NULL WHEN 3 THEN 'Tool ''extract_fields_vision'' requires ''page_num''.'
  ELSE 'Tool ''extract_fields_vision'' has invalid params: [''' || CASE k % 4 WHEN 1 THEN 'page' ELSE 'page_index' END || ''']. Allowed: [''field_names'', ''field_subset'', ''fields'', ''hints'', ''page_num'', ''region'']' END
WHEN tool = 'crop_region' THEN CASE k % 4 WHEN 0 THEN 'Tool ''crop_region'' requires ''region''.' WHEN 3 THEN 'Tool ''crop_region'' requires either ''page_num'' or ''image_path''.' WHEN 1 THEN 'Tool ''crop_region'' has invalid params: [''page'']. Allowed: [''custom_bbox'', ''image_path'', ''page_num'', ''region'']'
  ELSE 'Tool ''crop_region'' has invalid params: [''fields'', ''page_index'']. Allowed: [''custom_bbox'', ''image_path'', ''page_num'', ''region'']' END
WHEN tool = 'note' THEN CASE k % 4 WHEN 3 THEN 'Tool ''note'' requires ''text''.' ELSE 'Tool ''note'' has invalid params: [' || CASE k % 4 WHEN 0 THEN '''page_num''' WHEN 1 THEN '''page''' ELSE '''fields'', ''page_index''' END || ']. Allowed: [''text'']' END
ELSE CASE k % 4 WHEN 3 THEN NULL ELSE 'Tool ''' || tool || ''' has invalid params: [' || CASE k % 4 WHEN 0 THEN '''page_num''' WHEN 1 THEN '''page''' ELSE '''fields'', ''page_index''' END || ']. Allowed: []' END END AS contract_error FROM lg""",
    "duplicate_action_streak": with_(*BASE, _STREAK) + "SELECT run_id, seq, streak, CASE WHEN tool = 'check_compliance' THEN NULL WHEN streak >= 5 THEN 'stop' WHEN streak >= 2 THEN 'warn' END AS signal FROM c",
    "consecutive_failures": with_(*BASE, _FAIL) + "SELECT run_id, seq, CAST(failures AS BIGINT) AS failures, failures >= 3 AS stop FROM b",
    "model_escalation": with_(*BASE, _FAIL, _TOTAL) + "SELECT run_id, seq, CAST(total AS BIGINT) AS total_failures, total >= 2 AS escalate FROM tot",
    "compliance_same_result_streak": with_(*BASE, _SAME) + "SELECT run_id, seq, s AS same_result_streak, s >= 2 AS loop_guard, same AND turn - pt <= 3 AS redundant FROM d WHERE tool = 'check_compliance'",
    "null_only_extraction": with_(*BASE) + "SELECT run_id, seq, row_number() OVER (PARTITION BY run_id, CASE WHEN k % 4 = 0 THEN 'p' WHEN k % 4 = 2 THEN 'f' ELSE '' END ORDER BY seq) AS occurrence, occurrence >= 2 AS alert FROM lg WHERE tool = 'extract_fields_vision' AND k % 3 > 0",
    "token_cap": with_(*BASE, f"a AS (SELECT *, CAST(sum(tokens) OVER {W}) AS BIGINT) AS cum FROM lg)") + "SELECT run_id, seq, cum AS cumulative_tokens, cum > 3000 AS over_cap, cum >= 1200 AND cum - tokens < 1200 AND cum <= 3000 AS warns FROM a",
    "request_caps": with_(*BASE, f"a AS (SELECT *, sum((kind = 'chat')::INT) OVER {W}) - (kind = 'chat')::INT AS c, sum((kind = 'generate')::INT) OVER {W}) - (kind = 'generate')::INT AS g FROM lg)") + "SELECT run_id, seq, turn >= 50 OR (kind = 'chat' AND c >= 15) OR (kind = 'generate' AND g >= 20) AS rejected FROM a",
    "usage_totals": with_(*BASE) + "SELECT run_id, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (kind = 'chat') AS chat_calls, count(*) FILTER (kind = 'generate') AS generate_calls FROM lg GROUP BY run_id",
    "usage_tokens": with_(*BASE) + "SELECT seq, CASE k % 5 WHEN 4 THEN 0 WHEN 2 THEN tokens + 4 ELSE tokens END AS used FROM lg",
    "phase_changes": with_(*BASE, "a AS (SELECT run_id, seq, CASE WHEN k % 10 = 0 THEN 'SCAN' WHEN k % 3 = 0 OR (k % 2 = 0 AND k % 5 > 2) THEN 'VALIDATE' ELSE 'EXTRACT' END AS phase FROM lg)", f"b AS (SELECT *, lag(phase) OVER {W}) AS before FROM a)") + "SELECT run_id, seq, phase FROM b WHERE before IS DISTINCT FROM phase",
    "step_durations": with_(*BASE) + f"SELECT run_id, seq, elapsed_ms, CAST(sum(elapsed_ms) OVER {W}) AS BIGINT) AS total_ms FROM lg",
    "result_summary": with_(*BASE) + """SELECT tool, count(*) AS calls, count(*) FILTER (ev = 'error' AND k % 2 = 1) AS failed_calls, count(*) FILTER (ev = 'view') AS fields_merged, CAST(sum(CASE WHEN ev = 'view' THEN k % 5 ELSE 0 END) AS BIGINT) AS null_fields, CAST(0 AS BIGINT) AS kept_fields, CAST(0 AS BIGINT) AS pages,
CAST(sum(CASE WHEN ev NOT IN ('view', 'error') THEN k % 7 ELSE 0 END) AS BIGINT) AS rules_passed, CAST(0 AS BIGINT) AS rule_errors FROM lg GROUP BY tool""",
    "document_phase": with_(*RESULTS, _WORK) + "SELECT doc_id, CASE WHEN NOT typed THEN 'SCAN' WHEN results OR (full_q AND fields_) THEN 'VALIDATE' ELSE 'EXTRACT' END AS phase FROM wk",
    "next_required_step": with_(*RESULTS, _WORK) + "SELECT doc_id, CASE WHEN NOT typed AND NOT compressed THEN 'compress_pages(dpi=48, quality=30)' WHEN NOT typed AND NOT inventory THEN 'inventory_pages()' WHEN NOT typed THEN 'classify_document_type()' WHEN NOT results AND NOT full_q THEN 'convert_pdf_to_images(dpi=150)' WHEN pending THEN 'check_compliance_visual(page_num=N) — visual checks are pending' ELSE '' END AS step FROM wk",
}
