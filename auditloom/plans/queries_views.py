"""Review-view queries over the canonical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scale import grown, ordered
from . import canonical as C
from . import queries_canonical as QC
from . import scenario
from . import views as V
from .registry import query


def base(spark, sf_dir):
    """(invoices, results, labels, sources) of the audit."""
    runs, fields, verdicts, evidence = QC.states(spark, sf_dir)
    invoices = C.canonical_invoice_summary(runs, fields, verdicts).join(grown(runs.select("run_id", "web_view_link")), "run_id")
    results = C.canonical_compliance_results(runs, verdicts, fields, evidence)
    sources = V.rule_sources(scenario.rules(spark))
    return invoices, results, V.rule_labels(sources), sources


def facts(spark, sf_dir):
    invoices, results, labels, _ = base(spark, sf_dir)
    return V.invoice_facts(invoices, results, labels)


@query("compliance_matrix")
def compliance_matrix(spark, sf_dir):
    invoices, results, labels, _ = base(spark, sf_dir)
    wide = V.compliance_matrix(invoices, results, labels)
    return wide.toDF(*[c.lower().replace(" - ", "_").replace(" ", "_") for c in wide.columns])


@query("compliance_matrix_long")
def compliance_matrix_long(spark, sf_dir):
    invoices, results, labels, _ = base(spark, sf_dir)
    return V.compliance_matrix_long(invoices, results, labels).select("invoice_id", "rule_id", "label", "status")


@query("matrix_missing_status")
def matrix_missing_status(spark, sf_dir):
    docs = scenario.documents(spark, sf_dir)
    kinds = F.explode(F.array(*[F.lit(t[1]) for t in scenario.TYPES], F.lit(""))).alias("rule_type")
    return docs.select("doc_id", "invoice_type_id", kinds).select(
        "doc_id", "rule_type", V.missing_cell(F.col("invoice_type_id"), F.col("rule_type")).alias("status"))


@query("reject_ambiguous")
def reject_ambiguous(spark, sf_dir):
    _, results, _, _ = base(spark, sf_dir)
    return V.reject_ambiguous(results.unionByName(results.filter("rule_id LIKE '%01'")))


@query("invoice_review_summary")
def invoice_review_summary(spark, sf_dir):
    return ordered(V.invoice_review_summary(facts(spark, sf_dir)), "invoice_file")


@query("review_queue")
def review_queue(spark, sf_dir):
    return V.order_review_queue(V.review_queue(facts(spark, sf_dir)))


@query("review_issues")
def review_issues(spark, sf_dir):
    invoices, results, labels, _ = base(spark, sf_dir)
    return V.order_review_issues(V.review_issues(V.invoice_facts(invoices, results, labels, with_issues=True), results, labels))


@query("dashboard")
def dashboard(spark, sf_dir):
    invoices, results, labels, _ = base(spark, sf_dir)
    return V.order_dashboard(V.dashboard(V.invoice_facts(invoices, results, labels), results, labels))


@query("rule_guide")
def rule_guide(spark, sf_dir):
    _, results, labels, sources = base(spark, sf_dir)
    return V.order_rule_guide(V.rule_guide(results, sources, labels))


@query("rule_guide_entries")
def rule_guide_entries(spark, sf_dir):
    _, results, _, _ = base(spark, sf_dir)
    return V.rule_guide_entries(results).select("rule_id", "kind", "entry")


@query("status_pivot")
def status_pivot(spark, sf_dir):
    _, results, _, _ = base(spark, sf_dir)
    return V.status_pivot(results)


@query("matrix_column_notes")
def matrix_column_notes(spark, sf_dir):
    _, results, labels, sources = base(spark, sf_dir)
    return V.matrix_column_notes(V.rule_guide(results, sources, labels))


@query("rule_labels")
def rule_labels(spark, sf_dir):
    _, results, _, _ = base(spark, sf_dir)
    return V.rule_labels(V.rule_sources(scenario.rules(spark).filter("rule_order > 10"), results)).select("rule_id", "label")


@query("missing_critical_fields")
def missing_critical_fields(spark, sf_dir):
    return QC.summary(spark, sf_dir).select("invoice_id", F.array_join(V.missing_critical_fields(), "; ").alias("missing"))


@query("action_rows")
def action_rows(spark, sf_dir):
    _, results, _, _ = base(spark, sf_dir)
    st = V.result_status(F.col("normalized_status"))
    return results.filter(V.is_action(st)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("rows"))


@query("needs_attention")
def needs_attention(spark, sf_dir):
    return facts(spark, sf_dir).select("invoice_id", V.needs_attention().alias("needs_attention"))


@query("source_url")
def source_url(spark, sf_dir):
    runs = scenario.runs(spark, sf_dir)
    return runs.select("doc_id", V.source_url(runs.columns).alias("source_url"))


@query("policy_summary")
def policy_summary(spark, sf_dir):
    _, results, _, _ = base(spark, sf_dir)
    return results.select("invoice_id", "rule_id", V.policy_summary(F.col("policy_refs")).alias("policy_summary"))


@query("rule_topic")
def rule_topic(spark, sf_dir):
    _, results, labels, _ = base(spark, sf_dir)
    rows = V.labelled(results, labels)
    hay = V.rule_haystack()
    return rows.select("invoice_id", "rule_id", V.rule_topic(hay).alias("topic"),
                       F.array_join(V.amount_fields(hay), "|").alias("amount_fields"),
                       V.looks_missing(F.col("message"), F.col("agent_notes")).alias("looks_missing"))


@query("contradictions")
def contradictions(spark, sf_dir):
    return facts(spark, sf_dir).select("invoice_id", F.explode("contradiction_list").alias("contradiction"))


@query("recommended_action")
def recommended_action(spark, sf_dir):
    return facts(spark, sf_dir).select("invoice_id", V._action_of_facts().alias("recommended_action"))


@query("review_priority")
def review_priority(spark, sf_dir):
    return V.review_queue(facts(spark, sf_dir)).groupBy("priority", "review_status").agg(F.count(F.lit(1)).alias("invoices"))
