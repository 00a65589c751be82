"""Extraction queries over attempts and field results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from . import scenario
from .registry import query


@query("merge_extractions")
def merge_extractions(spark, sf_dir):
    return X.merge_extractions(scenario.extraction_attempts(spark, sf_dir), payload=("value_text", "source_page"), chunk_rows=scenario.SEQ_SPAN)


@query("merge_extractions_ignore_nulls")
def merge_ignore_nulls(spark, sf_dir):
    return X.merge_extractions(scenario.extraction_attempts(spark, sf_dir), ignore_nulls=True, chunk_rows=scenario.SEQ_SPAN).drop("extraction_attempts")


@query("coerce_attempts")
def coerce_attempts(spark, sf_dir):
    fr = scenario.field_results(spark, sf_dir).withColumn(
        "value_text", F.when(F.col("field_name") == "vendor_name", F.concat(F.lit("<b>"), "value_text", F.lit("</b>&nbsp;")))
        .otherwise(F.col("value_text")))
    raw = fr.select("doc_id", "invoice_type_id", "field_name", "value_text", "confidence")
    return X.coerce_attempts(raw, scenario.fields(spark)).select(
        "doc_id", "field_id", "field_name", "value_text", "value_num", "confidence")


@query("field_retry_counts")
def field_retry_counts(spark, sf_dir):
    return X.field_retry_counts(scenario.extraction_attempts(spark, sf_dir))


@query("confidence_band")
def confidence_band(spark, sf_dir):
    fr = scenario.field_results(spark, sf_dir)
    return fr.select("doc_id", "field_name", X.confidence_band(
        F.col("value_text"), F.col("confidence"), F.col("flagged_for_review")).alias("band"))


@query("flag_for_review")
def flag_for_review(spark, sf_dir):
    fr = scenario.field_results(spark, sf_dir).withColumn("review_reason", F.lit(None).cast("string"))
    flags = scenario.documents(spark, sf_dir).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, "currency").otherwise("payment_method").alias("field_name"),
        F.concat(F.lit("look at "), "invoice_file").alias("reason"))
    return X.flag_for_review(fr, flags).select(
        "doc_id", "field_id", "field_name", "value_text", "confidence", "flagged_for_review", "review_reason")


@query("backfill_fields")
def backfill_fields(spark, sf_dir):
    fr = scenario.field_results(spark, sf_dir).withColumns({
        "source_region": F.lit("body"), "extraction_attempts": F.lit(1), "review_reason": F.lit(None).cast("string")})
    k = F.col("doc_id")
    updates = F.create_map(
        F.lit("currency"), F.when(k % 2 == 0, "EUR").otherwise("<i> </i>"),
        F.lit(" vendor_name "), F.concat(F.lit("Seller "), "rule_id"), F.lit("unknown_field"), F.lit("x"))
    verdicts = scenario.visual_verdicts(spark, sf_dir).withColumn("field_updates", updates)
    return X.backfill_fields(fr, verdicts, scenario.fields(spark)).select(
        "doc_id", "field_name", "value_text", "confidence", "source_page", "source_region", "flagged_for_review",
        "review_reason", "backfilled")


def _tried(spark, sf_dir):
    """Attempts of schema fields: each line item tries one of the twelve."""
    names = F.array(*[F.lit(f[1]) for f in scenario.FIELDS])
    return scenario.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.element_at(names, (1 + F.col("l_partkey") % len(scenario.FIELDS)).cast("int")).alias("field_name"),
        F.col("l_linenumber").alias("pos"))


@query("unattempted_fields")
def unattempted_fields(spark, sf_dir):
    return X.unattempted_fields(scenario.documents(spark, sf_dir), scenario.fields(spark), _tried(spark, sf_dir)).select(
        "doc_id", "field_name")


@query("next_field_batch")
def next_field_batch(spark, sf_dir):
    tried = _tried(spark, sf_dir)
    untried = X.unattempted_fields(scenario.documents(spark, sf_dir), scenario.fields(spark), tried)
    return X.next_field_batch(tried, untried)
