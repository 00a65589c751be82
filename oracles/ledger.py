from .base import DOCS, with_

REFS = "refs AS (SELECT 's' || doc_id || '#' || (o_custkey % 3) AS key, 's' || doc_id AS source_id, invoice_file AS display_name, doc_id AS num FROM docs)"
LEDGER = """led AS (SELECT 's' || doc_id || '#' || CASE WHEN doc_id % 13 = 0 THEN 'old' ELSE CAST(o_custkey % 3 AS VARCHAR) END AS key, ['done', 'failed', 'processing', 'needs_attention', 'legacy', 'processing'][1 + o_custkey % 6] AS status,
  CAST(o_custkey % 5 AS INTEGER) AS attempts, 96500.0::DOUBLE + doc_id % 3500 AS claimed_at, CAST(1 + o_custkey % 4 AS INTEGER) AS version, 'r0' AS run_id FROM docs WHERE o_custkey % 7 <> 6)"""
DECIDED = """dec0 AS (SELECT r.key, num, l.status, l.attempts, l.claimed_at, l.version, l.run_id, CASE WHEN l.key IS NULL THEN 'new' WHEN status = 'done' THEN 'already_done' WHEN status = 'needs_attention' THEN 'parked'
  WHEN status = 'failed' THEN CASE WHEN attempts >= 3 THEN 'exhausted' ELSE 'retry' END WHEN status = 'processing' THEN CASE WHEN 100000 - claimed_at <= 1800 THEN 'in_progress' WHEN attempts >= 3 THEN 'stale_exhausted' ELSE 'reclaim_stale' END
  ELSE 'unknown_reset' END AS reason FROM refs r LEFT JOIN led l ON l.key = r.key),
dec AS (SELECT *, reason IN ('new', 'retry', 'reclaim_stale', 'unknown_reset') AS claimable FROM dec0),
chg AS (SELECT key, num, CASE WHEN claimable THEN 'processing' ELSE 'needs_attention' END AS status, CAST(coalesce(attempts, 0) + CASE WHEN claimable THEN 1 ELSE 0 END AS INTEGER) AS attempts,
  CASE WHEN claimable THEN 100000.0::DOUBLE ELSE claimed_at END AS claimed_at, 100000.0::DOUBLE AS updated_at, CAST(coalesce(version, 0) + 1 AS INTEGER) AS version, CASE WHEN claimable THEN 'r1' ELSE run_id END AS run_id FROM dec WHERE claimable OR reason = 'stale_exhausted'),
ter0 AS (SELECT *, num % 10 = 0 OR num % 5 = 1 AS bad FROM chg WHERE status = 'processing'),
ter AS (SELECT key, CASE WHEN NOT bad THEN 'done' WHEN attempts >= 3 THEN 'needs_attention' ELSE 'failed' END AS status, attempts, CAST(version + 1 AS INTEGER) AS version, NOT bad AND num % 4 = 0 AS needs_review,
  CASE WHEN num % 10 = 0 THEN 'no outcome' WHEN num % 5 = 1 THEN 'boom ' || length(key) ELSE '' END AS last_error FROM ter0)"""
BASE = (DOCS, REFS, LEDGER, DECIDED)
SQL = {
    "decide_claim": with_(*BASE) + "SELECT key, reason, claimable FROM dec",
    "apply_claim": with_(*BASE) + "SELECT * EXCLUDE (num) FROM chg",
    "mark_outcomes": with_(*BASE) + "SELECT * FROM ter",
    "ledger_upsert": with_(*BASE) + """SELECT status, count(*) AS keys, CAST(sum(attempts) AS BIGINT) AS attempts, CAST(sum(version) AS BIGINT) AS versions FROM (
SELECT key, status, attempts, version FROM led WHERE key NOT IN (SELECT key FROM chg) UNION ALL SELECT key, status, attempts, version FROM chg WHERE key NOT IN (SELECT key FROM ter) UNION ALL SELECT key, status, attempts, version FROM ter) GROUP BY status""",
    "ledger_latest": with_(*BASE) + """SELECT * FROM (SELECT key, status, version, run_id FROM led UNION ALL SELECT key, status, version, run_id FROM chg UNION ALL SELECT key, status, version, 'r1' FROM ter) QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC) = 1""",
    "poll_summary": with_(*BASE) + """SELECT count(*) AS scanned, count(*) FILTER (claimable) AS claimed, count(*) FILTER (claimable AND t.status = 'done' AND NOT needs_review) AS processed_ok, count(*) FILTER (claimable AND t.status = 'done' AND needs_review) AS needs_review,
count(*) FILTER (claimable AND t.status <> 'done') AS failed, count(*) FILTER (NOT claimable) AS skipped FROM dec LEFT JOIN ter t USING (key)""",
    "poll_candidates": with_(DOCS, REFS) + "SELECT source_id, display_name FROM refs ORDER BY lower(display_name) LIMIT 50",
    "unseen_revisions": with_(DOCS, REFS, LEDGER) + "SELECT key FROM refs WHERE key NOT IN (SELECT key FROM led WHERE status = 'done')",
}
