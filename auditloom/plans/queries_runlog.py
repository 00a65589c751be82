"""Run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runlog as G
from . import queries_rules as Q
from . import scenario
from .registry import query


def log(spark, sf_dir):
    """Events as agent actions."""
    e = scenario.run_log(spark, sf_dir)
    k = F.col("k")
    tool = F.when(F.col("tool") == "view", "extract_fields_vision").when(F.col("tool") == "click", "crop_region").when(
        F.col("tool") == "signup", "check_compliance").when(F.col("tool") == "purchase", "note").otherwise("inspect_file")
    params = F.when(k % 4 == 0, '{"page_num": 1}').when(k % 4 == 1, '{"page": 1}').when(k % 4 == 2, '{"page_index": "2, 3", "fields": ["a", "b"]}').otherwise("{}")
    result = F.when(F.col("tool") == "view", F.concat(F.lit('{"success": true, "merge_result": {"updated": ["f'), k % 3, F.lit('"], "null_fields": '), k % 5, F.lit("}}"))).when(
        F.col("tool") == "error", F.concat(F.lit('{"success": '), (k % 2 == 0).cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"passed": '), k % 7, F.lit("}")))
    return e.select("run_id", "seq", tool.alias("tool"), params.alias("params"), F.lit("why").alias("reasoning"), result.alias("result"),
                    ((F.col("tool") != "error") | (k % 2 == 0)).alias("success"), F.floor("value").cast("bigint").alias("tokens"),
                    (k * 10).alias("elapsed_ms"), F.when(F.col("tool").isin("view", "signup"), "chat").otherwise("generate").alias("kind"),
                    (k % 2).alias("result_hash"), ((F.col("tool") == "view") & (k % 9 == 0)).alias("updates"), "k")


@query("canonical_params")
def canonical_params(spark, sf_dir):
    p = G.canonical_params(F.col("params"))
    return log(spark, sf_dir).select("seq", p["page_num"].alias("page"), p["field_subset"].alias("fields"), G.page_number(p["page_num"]).alias("page_no"))


@query("validate_actions")
def validate_actions(spark, sf_dir):
    return G.validate_actions(log(spark, sf_dir)).select("seq", "contract_error")


@query("duplicate_action_streak")
def duplicate_action_streak(spark, sf_dir):
    return G.duplicate_action_streak(log(spark, sf_dir)).select("run_id", "seq", "streak", "signal")


@query("consecutive_failures")
def consecutive_failures(spark, sf_dir):
    return G.consecutive_failures(log(spark, sf_dir)).select("run_id", "seq", "failures", "stop")


@query("model_escalation")
def model_escalation(spark, sf_dir):
    return G.consecutive_failures(log(spark, sf_dir)).select("run_id", "seq", "total_failures", "escalate")


@query("compliance_same_result_streak")
def compliance_repeats(spark, sf_dir):
    return G.compliance_repeats(G.numbered(log(spark, sf_dir))).select("run_id", "seq", "same_result_streak", "loop_guard", "redundant")


@query("null_only_extraction")
def null_only(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("null_only", (F.col("tool") == "extract_fields_vision") & (F.col("k") % 3 > 0))
    return G.null_only_extractions(rows).select("run_id", "seq", "occurrence", "alert")


@query("token_cap")
def token_cap(spark, sf_dir):
    return G.token_cap(log(spark, sf_dir), 3000, 1200).select("run_id", "seq", "cumulative_tokens", "over_cap", "warns")


@query("request_caps")
def request_caps(spark, sf_dir):
    return G.request_caps(log(spark, sf_dir), 50, 15, 20).select("run_id", "seq", "rejected")


@query("usage_totals")
def usage_totals(spark, sf_dir):
    return G.usage_totals(log(spark, sf_dir))


@query("usage_tokens")
def usage_tokens(spark, sf_dir):
    t = F.col("tokens")
    raw = F.when(F.col("k") % 5 == 0, F.concat(F.lit('{"usageMetadata": {"totalTokenCount": '), t, F.lit("}}"))).when(
        F.col("k") % 5 == 1, F.concat(F.lit('{"usage_metadata": {"total_token_count": '), t, F.lit("}}"))).when(
        F.col("k") % 5 == 2, F.concat(F.lit('{"usageMetadata": {"promptTokenCount": '), t, F.lit(', "candidatesTokenCount": 4}}'))).when(
        F.col("k") % 5 == 3, F.concat(F.lit('{"usage": {"total_tokens": '), t, F.lit("}}"))).otherwise("{}")
    return log(spark, sf_dir).select("seq", G.usage_tokens(raw).alias("used"))


@query("phase_changes")
def phase_changes(spark, sf_dir):
    k = F.col("k")
    rows = log(spark, sf_dir).withColumn("phase", G.document_phase(k % 10 > 0, k % 3 == 0, k % 2 == 0, k % 5 > 2))
    return G.phase_changes(rows).select("run_id", "seq", "phase")


@query("step_durations")
def step_durations(spark, sf_dir):
    return G.step_durations(log(spark, sf_dir)).select("run_id", "seq", "elapsed_ms", "total_ms")


@query("result_summary")
def result_summary(spark, sf_dir):
    return G.result_summary(log(spark, sf_dir))


def worklist(spark, sf_dir):
    checked = Q.results(spark, sf_dir).groupBy("doc_id").agg(F.max(F.coalesce(F.col("skip_kind") == "visual", F.lit(False))).alias("pending"))
    docs = scenario.documents(spark, sf_dir).join(checked, "doc_id", "left")
    k = F.col("doc_id")
    return docs.select("doc_id", (k % 11 > 0).alias("typed"), (k % 2 == 0).alias("compressed"), (k % 4 == 0).alias("inventory"),
                       (k % 3 > 0).alias("results"), (k % 5 > 1).alias("full"), F.coalesce("pending", F.lit(False)).alias("pending"), (k % 7 > 0).alias("fields"))


@query("document_phase")
def document_phase(spark, sf_dir):
    c = F.col
    return worklist(spark, sf_dir).select("doc_id", G.document_phase(c("typed"), c("results"), c("full"), c("fields")).alias("phase"))


@query("next_required_step")
def next_required_step(spark, sf_dir):
    c = F.col
    step = G.next_required_step(c("typed"), c("compressed"), c("inventory"), c("results"), c("full"), c("pending"))
    return worklist(spark, sf_dir).select("doc_id", step.alias("step"))
