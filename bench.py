"""Time the headline queries; each prints a JSON line with all figures so far, the last line has them all."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from auditloom.plans.registry import load_all
from auditloom.session import build_session

HEADLINE = (
    "merge_extractions", "normalize_numeric", "evaluate_rules", "canonical_invoice_summary", "compliance_matrix", "review_queue",
    "link_pages", "localize_values", "compare_value", "match_truth_by_name", "duplicate_action_streak", "token_cap",
    "decide_claim", "parse_learnings", "compliance_report", "canonical_compliance_results", "review_issues", "dashboard", "rule_guide",
    "evidence_slots", "score_documents", "consecutive_failures", "ledger_latest", "contained_learnings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false",
        # Small test data, heavy expressions: keep all local cores busy after a shuffle.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("OFF")
    queries = load_all()
    names = sys.argv[1:] or HEADLINE
    queries["normalize_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        # A full line after each query, so that a run broken off leaves its figures; ``left`` names what has not run.
        print(json.dumps({"metric": "headline audit queries, total wall time", "value": round(sum(timings.values()), 3), "unit": "sec",
                          "queries": timings, "sf": Path(sf_dir).name.removeprefix("sf"), "left": list(names[len(timings):])}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
