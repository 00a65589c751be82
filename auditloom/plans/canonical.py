"""The two canonical tables every view is derived from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.blanks import text_or_empty
from ..operators import rules as R
from ..operators.scale import grown, join_inside


def normalize_agent_status(status: Column) -> Column:
    low = F.lower(F.trim(text_or_empty(status)))
    return (
        F.when(low == "interrupted", "error")
        .when(low.isin(*S.CANONICAL_STATUSES), low)
        .otherwise("unknown")
    )


def normalize_rule_status(status: Column, severity: Column) -> Column:
    low = F.lower(F.trim(text_or_empty(status)))
    # Looked up, so that the status is mentioned once: Catalyst copies it into every mention.
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(s) for s in ("passed", "failed", "skipped", "flagged") for _ in "kv"]), low), F.lit("unknown"))
    return F.when(F.lower(F.trim(text_or_empty(severity))) == "warning", F.replace(known, F.lit("failed"), F.lit("warning"))).otherwise(known)


def review_status(agent: Column, flagged: Column, errors: Column, warnings: Column) -> Column:
    """Ordered precedence over the normalised run status and the counts."""
    return (
        F.when(agent == "error", "error")
        .when(agent == "needs_review", "needs_review")
        .when((flagged > 0) | (errors > 0), "needs_review")
        .when(warnings > 0, "warning")
        .when(agent == "passed", "passed")
        .when(agent == "failed", "failed")
        .otherwise("unknown")
    )


def stringify(value: Column, data_type: str) -> Column:
    """Any cell as a string: null is empty, lists join with ``'; '``, structs are JSON."""
    if data_type.startswith("array<struct") or data_type.startswith("array<map"):
        return F.coalesce(F.array_join(F.transform(value, lambda v: F.to_json(v)), "; "), F.lit(""))
    if data_type.startswith("array"):
        return F.coalesce(F.array_join(F.transform(value, lambda v: text_or_empty(v)), "; "), F.lit(""))
    if data_type.startswith("struct") and "refs:array" in data_type:
        inner = "array<struct>" if "refs:array<struct" in data_type else "array<string>"
        return stringify(value["refs"], inner)
    if data_type.startswith(("struct", "map")):
        return F.coalesce(F.to_json(value), F.lit(""))
    if data_type == "boolean":
        return F.when(value, "True").when(~value, "False").otherwise("")
    return text_or_empty(value)


def stringify_all(df: DataFrame) -> DataFrame:
    return df.select(*[stringify(F.col(f"`{n}`"), t).alias(n) for n, t in df.dtypes])


def field_facts(field_results: DataFrame) -> DataFrame:
    """Per document: field counts and the high-value fields, one aggregation."""
    return field_results.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("fields_extracted"),
        F.count_if(F.coalesce("flagged_for_review", F.lit(False))).alias("fields_flagged"),
        *[F.max(F.when(F.col("field_name") == n, F.col("value_text"))).alias(n) for n in S.HIGH_VALUE_FIELDS],
    )


def canonical_invoice_summary(runs: DataFrame, field_results: DataFrame, rule_results: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """One typed row per document run (31 columns), followed by ``more`` columns of the run."""
    verdict = R.rule_verdict_summary(rule_results)
    rows = runs.join(grown(field_facts(field_results)), "doc_id", "left").join(grown(verdict), "doc_id", "left")
    zero = F.lit(0).cast("bigint")
    counts = {
        "fields_extracted": F.coalesce("fields_extracted", zero),
        "fields_flagged": F.coalesce("fields_flagged", zero),
        "rules_total": F.coalesce("rules_total", zero),
        "rules_passed": F.coalesce("passed_count", zero),
        "rules_failed_error": F.coalesce(F.size("error_failed_rule_ids"), F.lit(0)).cast("bigint"),
        "rules_failed_warning": F.coalesce(F.size("warning_failed_rule_ids"), F.lit(0)).cast("bigint"),
    }
    rows = rows.withColumns({**counts, "agent_status": normalize_agent_status(F.col("agent_status"))})
    rows = rows.withColumns(
        {
            "schema_version": F.lit(S.SCHEMA_VERSION),
            "review_status": review_status(
                F.col("agent_status"), F.col("fields_flagged"), F.col("rules_failed_error"), F.col("rules_failed_warning")
            ),
            "error_failed_rule_ids": F.coalesce(F.array_join("error_failed_rule_ids", "; "), F.lit("")),
            "warning_failed_rule_ids": F.coalesce(F.array_join("warning_failed_rule_ids", "; "), F.lit("")),
            **{n: F.coalesce(n, F.lit("")) for n in S.HIGH_VALUE_FIELDS},
        }
    )
    return rows.select(*S.INVOICE_SUMMARY, *more)


def field_pages(field_results: DataFrame) -> DataFrame:
    """First extracted page per (document, field id)."""
    order = "field_order" if "field_order" in field_results.columns else "field_name"
    return field_results.groupBy("doc_id", "field_id").agg(F.min_by("source_page", order).alias("source_page"))


def canonical_compliance_results(
    runs: DataFrame, rule_results: DataFrame, field_results: DataFrame, evidence: DataFrame | None = None, more: tuple[str, ...] = ()
) -> DataFrame:
    """One row per (document, rule), 19 columns, followed by ``more`` columns of the verdict.

    ``evidence`` optionally carries evidence_refs and policy_refs text per
    (doc_id, rule_id).
    """
    identity = runs.select("doc_id", "run_id", "invoice_id", "invoice_file", "source_type", "source_id", "source_hash")
    rows = join_inside(rule_results.join(grown(identity), "doc_id"), field_pages(field_results), "doc_id", ["field_id"])
    if evidence is not None:
        rows = join_inside(rows, evidence.select("doc_id", "rule_id", "evidence_refs", "policy_refs"), "doc_id", ["rule_id"])
    else:
        rows = rows.withColumns({"evidence_refs": F.lit(""), "policy_refs": F.lit("")})
    rows = rows.withColumns(
        {
            "schema_version": F.lit(S.SCHEMA_VERSION),
            "normalized_status": normalize_rule_status(F.col("status"), F.col("severity")),
            "source_page": text_or_empty(F.col("source_page")),
            **{c: text_or_empty(F.col(c)) for c in ("message", "agent_notes", "evidence_refs", "policy_refs")},
        }
    )
    return rows.select(*S.COMPLIANCE_RESULTS, *more)


def enrich_invoices(summary: DataFrame, runs: DataFrame, field_results: DataFrame) -> DataFrame:
    """Summary rows plus the web link and every other extracted value as a map.

    The map keeps the schema narrow; its size is bounded by the field schema. A summary that carries its
    doc_id meets runs and values by it, and keeps it.
    """
    extra = field_results.filter(~F.col("field_name").isin(*S.HIGH_VALUE_FIELDS)).groupBy("doc_id").agg(
        F.map_from_entries(
            F.collect_list(F.struct("field_name", text_or_empty(F.col("value_text"))))
        ).alias("extra_values")
    )
    link = F.col("web_view_link") if "web_view_link" in runs.columns else F.lit(None).cast("string")
    links = runs.select("doc_id", "run_id", text_or_empty(link).alias("web_view_link"))
    if "doc_id" in summary.columns:
        met = join_inside(summary.join(grown(extra), "doc_id", "left"), links, "doc_id", ["run_id"], "inner")
        return met.select(*[c for c in summary.columns if c != "doc_id"], "web_view_link", "extra_values", "doc_id")
    return summary.join(grown(links), "run_id").join(grown(extra), "doc_id", "left").drop("doc_id")


def run_summary(summary: DataFrame, timestamp: Column) -> DataFrame:
    """The 17-column rolling summary of runs."""
    return summary.withColumn("timestamp", timestamp).select(*S.RUN_SUMMARY)


def field_table(runs: DataFrame, field_results: DataFrame) -> DataFrame:
    """The 12-column field table, confidence with two decimals."""
    rows = field_results.join(grown(runs.select("doc_id", "invoice_file")), "doc_id").withColumns(
        {"extracted_value": F.col("value_text"), "confidence": F.format_string("%.2f", "confidence")}
    )
    return rows.select(*S.FIELD_TABLE)


def rule_table(runs: DataFrame, rule_results: DataFrame) -> DataFrame:
    """The 9-column verdict table."""
    return rule_results.join(grown(runs.select("doc_id", "invoice_file")), "doc_id").select(*S.RULE_TABLE)


def outcome(rows: DataFrame) -> DataFrame:
    """Publishing outcome per canonical summary row; error runs go to retry."""
    review = (
        (F.col("rules_failed_error") > 0) | (F.col("fields_flagged") > 0)
        | F.col("agent_status").isin("needs_review", "failed")
    )
    error = F.col("agent_status") == "error"
    return rows.select(
        "run_id", "invoice_id",
        F.when(error, "error").when(review, "needs_review").otherwise("ok").alias("outcome"),
        F.when(~error, review).alias("needs_review"),
        F.when(error, F.concat(F.lit("agent returned ERROR for "), "invoice_file", F.lit(": "),
                               F.coalesce(F.nullif("finish_reason", F.lit("")), F.lit("unknown")))).alias("error"),
    )
