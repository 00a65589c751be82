"""Canonical tables and sink tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from . import canonical as C
from . import queries_rules as Q
from . import scenario
from .registry import query


def states(spark, sf_dir):
    results = Q.results(spark, sf_dir)
    return scenario.runs(spark, sf_dir), scenario.field_results(spark, sf_dir), results, scenario.evidence(results)


def summary(spark, sf_dir):
    runs, fields, results, _ = states(spark, sf_dir)
    return C.canonical_invoice_summary(runs, fields, results)


def compliance(spark, sf_dir):
    runs, fields, results, evidence = states(spark, sf_dir)
    return C.canonical_compliance_results(runs, results, fields, evidence)


@query("canonical_invoice_summary")
def canonical_invoice_summary(spark, sf_dir):
    return C.stringify_all(summary(spark, sf_dir))


@query("canonical_compliance_results")
def canonical_compliance_results(spark, sf_dir):
    return C.stringify_all(compliance(spark, sf_dir))


@query("normalize_agent_status")
def normalize_agent_status(spark, sf_dir):
    raw = F.concat(F.lit(" "), F.upper("agent_status"))
    return scenario.runs(spark, sf_dir).select("doc_id", C.normalize_agent_status(raw).alias("agent_status"))


@query("normalize_rule_status")
def normalize_rule_status(spark, sf_dir):
    status = F.when(F.col("rule_order") % 5 == 0, "flagged").when(F.col("rule_order") % 7 == 0, "odd").otherwise(F.col("status"))
    return Q.results(spark, sf_dir).select("doc_id", "rule_id", C.normalize_rule_status(status, F.col("severity")).alias("status"))


@query("review_status")
def review_status(spark, sf_dir):
    return summary(spark, sf_dir).groupBy("agent_status", "review_status").agg(F.count(F.lit(1)).alias("documents"))


@query("enrich_invoices")
def enrich_invoices(spark, sf_dir):
    runs, fields, results, _ = states(spark, sf_dir)
    rows = C.enrich_invoices(C.canonical_invoice_summary(runs, fields, results), runs, fields)
    names = F.array_join(F.array_sort(F.map_keys("extra_values")), "|")
    return rows.select("run_id", "web_view_link", names.alias("extra_names"), F.try_element_at("extra_values", F.lit("units")).alias("units"))


@query("source_page_of_rule")
def source_page_of_rule(spark, sf_dir):
    pages = C.field_pages(scenario.field_results(spark, sf_dir))
    return scenario.documents(spark, sf_dir).join(scenario.rules(spark), "invoice_type_id").join(
        pages, ["doc_id", "field_id"], "left").select("doc_id", "rule_id", "source_page")


@query("high_value_fields")
def high_value_fields(spark, sf_dir):
    return C.field_facts(scenario.field_results(spark, sf_dir))


@query("write_fields_table")
def write_fields_table(spark, sf_dir):
    rows = scenario.field_results(spark, sf_dir).withColumns({
        "source_region": F.lit("body"), "extraction_attempts": F.lit(1), "review_reason": F.lit(None).cast("string"),
        "batch_review": F.col("confidence").between(0.65, 0.8499)})
    return C.stringify_all(C.field_table(scenario.runs(spark, sf_dir), rows))


@query("write_rule_results_table")
def write_rule_results_table(spark, sf_dir):
    return C.stringify_all(C.rule_table(scenario.runs(spark, sf_dir), Q.results(spark, sf_dir)))


@query("run_summary_rows")
def run_summary_rows(spark, sf_dir):
    return C.stringify_all(C.run_summary(summary(spark, sf_dir), F.lit("20240101_000000")))


@query("stringify_cells")
def stringify_cells(spark, sf_dir):
    o = scenario.read(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    rows = o.select(
        "o_orderkey", (F.col("o_custkey") % 2 == 0).alias("flag"), F.when(status != "P", status).alias("maybe"),
        F.array(status, F.lit(None).cast("string"), F.col("o_orderpriority")).alias("items"),
        F.array(F.struct(F.col("o_custkey").alias("page"), status.alias("source"))).alias("refs"),
        F.struct(status.alias("a"), F.array(F.lit("x"), status).alias("refs")).alias("slots"))
    return C.stringify_all(rows)


@query("outcome_needs_review")
def outcome_needs_review(spark, sf_dir):
    return C.outcome(summary(spark, sf_dir))


@query("sink_metrics")
def sink_metrics(spark, sf_dir):
    """Rows and cells each canonical table would write."""
    parts = []
    for name, df, columns in (("invoice_summary", summary(spark, sf_dir), S.INVOICE_SUMMARY),
                              ("compliance_results", compliance(spark, sf_dir), S.COMPLIANCE_RESULTS)):
        parts.append(df.groupBy(F.lit(name).alias("table_name")).agg(
            F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) * len(columns)).alias("cells")))
    return parts[0].unionByName(parts[1])


