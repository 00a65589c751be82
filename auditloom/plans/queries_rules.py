"""Rule-engine queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from . import scenario
from .registry import query


def results(spark, sf_dir):
    """Verdicts of every document, visual ones merged in."""
    base = R.evaluate_rules(scenario.dealt_documents(spark, sf_dir), scenario.typed_results(spark, sf_dir),
                            scenario.rules(spark), scenario.fields(spark))
    return R.merge_visual_verdicts(base, scenario.visual_verdicts(spark, sf_dir))


def first_pass(spark, sf_dir):
    return R.evaluate_rules(scenario.dealt_documents(spark, sf_dir), scenario.typed_results(spark, sf_dir),
                            scenario.rules(spark), scenario.fields(spark))


def _check(kind):
    def run(spark, sf_dir):
        only = scenario.rules(spark).filter(F.col("check_type") == kind)
        out = R.evaluate_rules(scenario.documents(spark, sf_dir), scenario.typed_results(spark, sf_dir), only,
                               scenario.fields(spark))
        return out.select("doc_id", "rule_id", "status", "severity", "skip_kind")

    return run


for _kind in (*R.CHECK_TYPES, "checksum"):
    query(f"check_{_kind.removesuffix('_check')}" if _kind != "checksum" else "check_unknown_type")(_check(_kind))


@query("evaluate_rules")
def evaluate_rules(spark, sf_dir):
    return first_pass(spark, sf_dir).select("doc_id", "rule_id", "field_id", "status", "severity", "skip_kind", "rule_order")


@query("field_required_lookup")
def field_required_lookup(spark, sf_dir):
    """Required flag per rule; a field id outside the schema counts as required."""
    ids = scenario.fields(spark).groupBy("field_id").agg(F.max("required").alias("known"))
    rules = scenario.rules(spark).join(ids, "field_id", "left").withColumn("required", F.coalesce("known", F.lit(True)))
    return scenario.documents(spark, sf_dir).join(rules, "invoice_type_id").select("doc_id", "rule_id", "required")


@query("resolve_field")
def resolve_field(spark, sf_dir):
    facts = R.field_map(scenario.field_results(spark, sf_dir))
    wanted = scenario.rules(spark).select("invoice_type_id", "rule_id", F.when(
        F.col("rule_order") % 2 == 0, F.col("field_id")).otherwise(F.lit("units")).alias("field_id"))
    rows = scenario.documents(spark, sf_dir).join(wanted, "invoice_type_id").join(facts, "doc_id")
    name = R._resolved(F.col("field_id"))
    return rows.select("doc_id", "rule_id", name.alias("field_name"), R._value(name)["text"].alias("value_text"))


@query("sticky_verdicts")
def sticky_verdicts(spark, sf_dir):
    prior = first_pass(spark, sf_dir).filter(F.col("rule_order") % 3 == 0).withColumns({
        "status": F.when(F.col("doc_id") % 2 == 0, "passed").otherwise(F.col("status")),
        "message": F.lit("earlier run")})
    out = R.evaluate_rules(scenario.documents(spark, sf_dir), scenario.typed_results(spark, sf_dir),
                           scenario.rules(spark), scenario.fields(spark), prior)
    return out.select("doc_id", "rule_id", "status", (F.col("message") == "earlier run").alias("kept"))


@query("merge_visual_verdicts")
def merge_visual_verdicts(spark, sf_dir):
    return results(spark, sf_dir).filter("check_type = 'visual_check'").select(
        "doc_id", "rule_id", "status", "message", "agent_notes", "skip_kind")


@query("rule_verdict_summary")
def rule_verdict_summary(spark, sf_dir):
    return R.rule_verdict_summary(results(spark, sf_dir)).select(
        "doc_id", "rules_total", "passed_count", F.array_join("error_failed_rule_ids", ";").alias("errors"),
        F.array_join("warning_failed_rule_ids", ";").alias("warnings"))


@query("compliance_report")
def compliance_report(spark, sf_dir):
    rep = R.compliance_report(results(spark, sf_dir))
    lists = ("failed_errors", "failed_warnings", "skipped_checks", "visual_checks_pending")
    return rep.select("doc_id", "total_rules", "passed", *[F.array_join(c, ";").alias(c) for c in lists], "all_errors_resolved")


def with_state(spark, sf_dir):
    none = F.array().cast("array<string>")
    slots = F.when((F.col("check_type") == "visual_check") & (F.col("status") == "skipped"),
                   F.array(F.lit("visual_observation"))).otherwise(none)
    return results(spark, sf_dir).withColumns({
        "missing_slots": slots, "rule_state": R.rule_state(F.col("status"), F.lit(True))})


@query("rule_state")
def rule_state(spark, sf_dir):
    r = results(spark, sf_dir)
    return r.select("doc_id", "rule_id", R.rule_state(F.col("status"), F.col("rule_order") % 2 == 0).alias("rule_state"))


@query("finish_status")
def finish_status(spark, sf_dir):
    return R.finish_status(with_state(spark, sf_dir), scenario.field_results(spark, sf_dir), scenario.documents(spark, sf_dir))


@query("remaining_gaps")
def remaining_gaps(spark, sf_dir):
    return R.remaining_gaps(first_pass(spark, sf_dir))
