"""Evidence, linkage, grounding and layout queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import layout as L
from . import queries_rules as Q
from . import scenario
from .registry import query


def facts(spark, sf_dir):
    return E.page_facts(scenario.page_rows(spark, sf_dir))


def links(spark, sf_dir):
    return E.link_support_pages(facts(spark, sf_dir))


@query("page_facts")
def page_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.select("doc_id", "page_num", "category", "doc_subtype", F.size("entities.amounts").alias("n_amounts"),
                    F.array_join("entities.dates", "|").alias("dates"), F.array_join("entities.references", "|").alias("refs"),
                    F.array_join("entities.payment_markers", "|").alias("markers"), "confidence")


@query("link_pages")
def link_pages(spark, sf_dir):
    return links(spark, sf_dir)


@query("required_slots")
def required_slots(spark, sf_dir):
    rows = scenario.documents(spark, sf_dir).join(scenario.rules(spark), "invoice_type_id")
    slots = E.required_slots(F.col("rule_name"), F.col("check_value"), F.col("check_type"))
    return rows.select("doc_id", "rule_id", F.array_join(slots, "|").alias("slots"))


def slots_of(spark, sf_dir):
    return E.evidence_slots(Q.results(spark, sf_dir), scenario.rules(spark), E.payment_evidence(links(spark, sf_dir)))


@query("evidence_slots")
def evidence_slots(spark, sf_dir):
    return slots_of(spark, sf_dir).select(
        "doc_id", "rule_id", *[F.array_join(c, "|").alias(c) for c in ("required_slots", "filled_slots", "missing_slots")])


@query("evidence_gaps")
def evidence_gaps(spark, sf_dir):
    return E.evidence_gaps(slots_of(spark, sf_dir)).withColumn("missing_slots", F.array_join("missing_slots", "|"))


def targets(spark, sf_dir):
    return scenario.documents(spark, sf_dir).select("doc_id", "invoice_type_id", (1 + F.col("doc_id") % 7).cast("int").alias("page_num"))


@query("evidence_pages")
def evidence_pages(spark, sf_dir):
    return E.evidence_pages(targets(spark, sf_dir), scenario.page_rows(spark, sf_dir), scenario.rules(spark))


@query("signature_page")
def signature_page(spark, sf_dir):
    return E.signature_page(targets(spark, sf_dir), scenario.page_rows(spark, sf_dir))


@query("category_union")
def category_union(spark, sf_dir):
    wanted = E.wanted_categories(scenario.rules(spark)).withColumn("categories", F.array_join("categories", "|"))
    return scenario.documents(spark, sf_dir).join(wanted, "invoice_type_id").groupBy("invoice_type_id", "categories").agg(
        F.count(F.lit(1)).alias("documents"))


@query("page_batches")
def page_batches(spark, sf_dir):
    return E.page_batches(scenario.page_rows(spark, sf_dir).select("doc_id", "page_num"), 5)


@query("batch_answers")
def batch_answers(spark, sf_dir):
    pages = scenario.page_rows(spark, sf_dir)
    told = E.page_batches(pages, 3).filter((F.col("doc_id") + F.col("page_num")) % 4 > 0).withColumn("category", F.lower("category"))
    extra = told.withColumn("position", F.col("position") + 3)
    return E.batch_answers(pages, told.unionByName(extra), 3)


@query("inventory_todo")
def inventory_todo(spark, sf_dir):
    counts = scenario.page_rows(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))
    done = counts.select("doc_id", (F.col("page_count") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).alias("page_count"))
    return E.inventory_todo(counts, done)


@query("policy_refs")
def policy_refs(spark, sf_dir):
    return E.policy_refs(scenario.rules(spark), scenario.learning_lines(spark, sf_dir))


@query("localize_labels")
def localize_labels(spark, sf_dir):
    found = L.localize_labels(scenario.ocr_lines(spark, sf_dir), scenario.fields(spark))
    return found.select("doc_id", "page_num", "field_name", "line_no", "text", "score")


def located(spark, sf_dir):
    return L.localize_values(scenario.ocr_lines(spark, sf_dir), scenario.fields(spark))


@query("localize_values")
def localize_values(spark, sf_dir):
    return located(spark, sf_dir).drop("image_width", "image_height")


@query("value_below_label")
def value_below_label(spark, sf_dir):
    lines = scenario.ocr_lines(spark, sf_dir)
    near = L.value_below(L.localize_labels(lines, scenario.fields(spark)), lines)
    return near.select("doc_id", "page_num", "field_name", F.col("below.line_no").alias("line_no"), F.col("below.text").alias("text"))


@query("route_extraction")
def route_extraction(spark, sf_dir):
    wanted = scenario.documents(spark, sf_dir).select("doc_id", "invoice_type_id").join(
        scenario.fields(spark).select("invoice_type_id", "field_name"), "invoice_type_id")
    found = located(spark, sf_dir).withColumn("found", F.lit(True))
    rows = wanted.join(found, ["doc_id", "field_name"], "left")
    route = L.route_extraction(F.col("found"), F.col("value_text"), F.col("value_confidence"))
    return rows.groupBy("field_name", route.alias("route")).agg(F.count(F.lit(1)).alias("fields"))


def crops(spark, sf_dir):
    boxes = located(spark, sf_dir).withColumn("region", F.when(F.col("field_name").endswith("amount"), "totals").otherwise("body"))
    return L.union_boxes(boxes)


@query("union_boxes")
def union_boxes(spark, sf_dir):
    return crops(spark, sf_dir)


@query("lines_in_crop")
def lines_in_crop(spark, sf_dir):
    return L.lines_in_crop(crops(spark, sf_dir), scenario.ocr_lines(spark, sf_dir))


@query("full_text")
def full_text(spark, sf_dir):
    docs = scenario.read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return L.full_text(lines, ("doc_id",)).select("doc_id", F.md5("full_text").alias("digest"))
