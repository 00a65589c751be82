"""Evidence slots, page linkage and policy grounding of verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blanks import text_or_empty
from ..functions.dates import date_token
from ..functions.text import contains_any, doc_subtype, extract_entities, keyword_set, normalize_category, target_categories
from .scale import grown

# Slot names, payment words, linkage tolerance, references per rule.
PAYMENT_SLOTS = ("receipt_page_candidate", "payment_indicator", "invoice_receipt_link")
PAYMENT_RULE_WORDS = ("proof_of_payment", "justificante", "payment")
LINKED_RULE_WORDS = ("payment", "justificante", "proof")
AMOUNT_TOLERANCE = 0.02
DIRECT_REFS = 3
KEYWORD_REFS = 2
NON_STAMP_CATEGORIES = ("LINE_ITEMS", "TOTALS", "BODY", "BLANK", "COVER_PAGE", "SUPPORTING_DOC", "UNKNOWN", "")
ALWAYS_WANTED = ("INVOICE_HEADER", "SIGNATURE_STAMP")
PAGE_FACT_CONFIDENCE = 0.6
LEARNING_LINE = r"^- \[(L\d+)\]"


def rule_text(rule_name: Column, check_value: Column) -> Column:
    return F.lower(F.concat_ws(" ", text_or_empty(rule_name), text_or_empty(check_value)))


def required_slots(rule_name: Column, check_value: Column, check_type: Column) -> Column:
    payment = contains_any(rule_text(rule_name, check_value), PAYMENT_RULE_WORDS)
    return (
        F.when(payment, F.array(*[F.lit(s) for s in PAYMENT_SLOTS]))
        .when(check_type == "visual_check", F.array(F.lit("visual_observation")))
        .otherwise(F.array(F.lit("field_values")))
    )


def page_facts(pages: DataFrame) -> DataFrame:
    """Category, subtype and entities per page from its description."""
    said = text_or_empty(F.col("description"))
    return pages.select(
        "doc_id", "page_num", normalize_category(F.col("category")).alias("category"), "description",
        doc_subtype(said).alias("doc_subtype"), extract_entities(said).alias("entities"),
        F.lit(PAGE_FACT_CONFIDENCE).alias("confidence"),
    )


def _cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def amounts_touch(left: Column, right: Column) -> Column:
    """Some pair of two-decimal amounts lies within the tolerance.

    Each left amount names the few cent values that satisfy the very comparison
    on doubles, so the test is a hash overlap, linear in both lists.
    """
    near = F.flatten(F.transform(left, lambda a: F.filter(
        F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: _cents(a) + d),
        lambda c: F.abs(a - c / 100.0) <= AMOUNT_TOLERANCE,
    )))
    return F.coalesce(F.arrays_overlap(near, F.transform(right, _cents)), F.lit(False))


def link_pages(left: Column, right: Column) -> Column:
    """Linkage struct of two entity structs: two of three shared signals link."""
    amount = amounts_touch(left["amounts"], right["amounts"])
    date = F.arrays_overlap(F.transform(left["dates"], date_token), F.transform(right["dates"], date_token))
    ref = F.arrays_overlap(F.transform(left["references"], F.lower), F.transform(right["references"], F.lower))
    signals = [F.coalesce(s, F.lit(False)) for s in (amount, date, ref)]
    total = sum((s.cast("int") for s in signals), F.lit(0))
    return F.struct(
        (total >= 2).alias("linked"), signals[0].alias("amount_match"), signals[1].alias("date_match"),
        signals[2].alias("reference_match"), total.alias("matched_signals"),
    )


def link_support_pages(facts: DataFrame, evidence_pages: DataFrame | None = None) -> DataFrame:
    """Header page of each document against its other (evidence) pages.

    One header row per document meets each page once; a document with very many
    pages is split by adaptive skew handling because its header side is one row.
    """
    header = facts.filter(F.col("category") == "INVOICE_HEADER").groupBy("doc_id").agg(
        F.min_by(F.struct("page_num", "entities"), "page_num").alias("_h")
    )
    support = facts if evidence_pages is None else facts.join(
        evidence_pages.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")
    pairs = support.join(grown(header), "doc_id").filter(F.col("page_num") != F.col("_h.page_num"))
    return pairs.select(
        "doc_id", F.col("_h.page_num").alias("invoice_page"), F.col("page_num").alias("supporting_page"),
        link_pages(F.col("_h.entities"), F.col("entities")).alias("link"),
        (F.size("entities.payment_markers") > 0).alias("has_payment_marker"),
    ).select("doc_id", "invoice_page", "supporting_page", "link.*", "has_payment_marker")


def payment_evidence(links: DataFrame) -> DataFrame:
    """Which payment slots the supporting pages of a document fill."""
    return links.groupBy("doc_id").agg(
        F.max("linked").alias("any_link"), F.max("has_payment_marker").alias("any_marker"),
        F.count(F.lit(1)).alias("support_pages"),
    )


def evidence_slots(results: DataFrame, rules: DataFrame, support: DataFrame) -> DataFrame:
    """required / filled / missing slots per (document, rule)."""
    info = rules.select("rule_id", "check_value")
    rows = results.join(F.broadcast(info), "rule_id", "left").join(grown(support), "doc_id", "left")
    rows = rows.withColumn("required_slots", required_slots(F.col("rule_name"), F.col("check_value"), F.col("check_type")))
    settled = F.col("status").isin("passed", "failed")
    visual = F.col("check_type") == "visual_check"
    payment = visual & settled & contains_any(rule_text(F.col("rule_name"), F.col("check_value")), LINKED_RULE_WORDS)

    def slot(name: str, condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(name))

    filled = F.array_sort(F.filter(F.array(
        slot("field_values", settled & ~visual & F.array_contains("required_slots", "field_values")),
        slot("visual_observation", settled & visual & F.array_contains("required_slots", "visual_observation")),
        slot("invoice_receipt_link", payment & F.col("any_link")),
        slot("payment_indicator", payment & F.col("any_marker")),
        slot("receipt_page_candidate", payment & (F.col("support_pages") > 0)),
    ), lambda s: s.isNotNull()))
    return rows.withColumn("filled_slots", filled).withColumn(
        "missing_slots", F.array_except("required_slots", "filled_slots")
    ).drop("any_link", "any_marker", "support_pages", "check_value")


def evidence_gaps(slots: DataFrame, shown: int | None = None) -> DataFrame:
    """Error-severity rules with missing slots, ranked in rule order; the first ``shown``, if given."""
    first = Window.partitionBy("doc_id").orderBy("rule_order")
    gaps = slots.filter((F.col("severity") == "error") & (F.size("missing_slots") > 0)).withColumn("rank", F.row_number().over(first))
    if shown is not None:
        gaps = gaps.filter(F.col("rank") <= shown)
    return gaps.select("doc_id", "rule_id", "rank", "missing_slots")


def wanted_categories(rules: DataFrame) -> DataFrame:
    """Page categories the visual rules of a type ask for."""
    asked = rules.filter("check_type = 'visual_check'").select(
        "invoice_type_id", F.explode(target_categories(rule_text(F.col("rule_name"), F.col("check_value")))).alias("_c")
    )
    return asked.groupBy("invoice_type_id").agg(
        F.array_sort(F.array_union(F.collect_set("_c"), F.array(*[F.lit(c) for c in ALWAYS_WANTED]))).alias("categories")
    )


def evidence_pages(targets: DataFrame, pages: DataFrame, rules: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages shown as evidence: the anchor, wanted categories by page, page one.

    ``targets`` carries doc_id, invoice_type_id and the anchor ``page_num``; with
    ``max_pages`` only so many pages of a document are shown.
    """
    anchor = targets.select("doc_id", "invoice_type_id", F.col("page_num").alias("_anchor"))
    rows = pages.select("doc_id", "page_num", "category").join(anchor, "doc_id").join(
        wanted_categories(rules), "invoice_type_id", "left"
    )
    rank = (
        F.when(F.col("page_num") == F.col("_anchor"), 0)
        .when(F.array_contains("categories", F.upper("category")), 1)
        .when(F.col("page_num") == 1, 2)
    )
    order = Window.partitionBy("doc_id").orderBy("_class", "page_num")
    ranked = rows.withColumn("_class", rank).filter(F.col("_class").isNotNull()).withColumn("position", F.row_number().over(order))
    if max_pages is not None:
        ranked = ranked.filter(F.col("position") <= max(1, max_pages))
    return ranked.select("doc_id", "page_num", "position")


def signature_page(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """Send a visual check to the first stamp page when its target has no stamp."""
    per_doc = pages.groupBy("doc_id").agg(
        F.min(F.when(F.col("category") == "SIGNATURE_STAMP", F.col("page_num"))).alias("_stamp"))
    here = pages.select("doc_id", "page_num", F.upper("category").alias("_cat"))
    rows = targets.join(here, ["doc_id", "page_num"], "left").join(per_doc, "doc_id", "left")
    move = F.col("_stamp").isNotNull() & F.coalesce("_cat", F.lit("")).isin(*NON_STAMP_CATEGORIES)
    return rows.select(
        "doc_id", F.col("page_num").alias("asked_page"),
        F.when(move, F.col("_stamp")).otherwise(F.col("page_num")).alias("page_num"),
    )


def page_batches(pages: DataFrame, batch_size: int) -> DataFrame:
    """Batch number and position of each page; size 0 means one batch."""
    at = F.col("page_num") - 1
    batch = F.lit(0) if batch_size <= 0 else F.floor(at / batch_size).cast("int")
    place = at if batch_size <= 0 else at % batch_size
    return pages.withColumns({"batch_no": batch.cast("int"), "position": place.cast("int")})


def batch_answers(pages: DataFrame, answers: DataFrame, batch_size: int) -> DataFrame:
    """Match answers to pages: missing ones become UNKNOWN, surplus ones vanish."""
    asked = page_batches(pages.select("doc_id", "page_num"), batch_size)
    told = answers.select("doc_id", "batch_no", "position", "category", "description", F.lit(True).alias("_told"))
    rows = asked.join(told, ["doc_id", "batch_no", "position"], "left")
    return rows.select(
        "doc_id", "page_num", normalize_category(F.col("category")).alias("category"),
        F.when(F.col("_told").isNull(), "(no response)").otherwise(F.trim(text_or_empty(F.col("description")))).alias("description"),
    )


def inventory_todo(documents: DataFrame, done: DataFrame) -> DataFrame:
    """Documents whose page inventory is absent or built for another page count."""
    return documents.join(done.select("doc_id", "page_count"), ["doc_id", "page_count"], "left_anti")


def policy_refs(rules: DataFrame, lines: DataFrame, fallback_source: str = "compliance_rules") -> DataFrame:
    """Policy references per rule: direct mentions, else best keyword overlap.

    ``lines`` carries invoice_type_id (GENERAL applies to every type), line_no
    and the text of each learning line.  Rules are configuration; lines are not:
    only the first few lines per rule leave a task before the ranking shuffle.
    """
    scoped = F.when(F.col("invoice_type_id") == "GENERAL", 0).otherwise(1)
    text = F.trim("text")
    base = lines.select(F.col("invoice_type_id").alias("_scope"), scoped.alias("_part"), "line_no", text.alias("line"))
    wanted = rules.select(
        "rule_id", "invoice_type_id", F.lower("rule_id").alias("_id"),
        keyword_set(F.concat_ws(" ", *[text_or_empty(F.col(c)) for c in ("agent_hint", "rule_name", "field_id", "check_type")])).alias("_words"),
        F.explode(F.array(F.lit("GENERAL"), F.col("invoice_type_id"))).alias("_scope"),
    )
    words = F.regexp_extract_all(F.lower("line"), F.lit("[a-z0-9_]+"), F.lit(0))
    mentioned = base.withColumn("_id", F.explode(F.array_distinct(words)))
    direct = mentioned.join(wanted.select("rule_id", "_scope", "_id"), ["_scope", "_id"])
    early = Window.partitionBy("rule_id").orderBy("_part", "line_no")
    direct = direct.withColumn("rank", F.row_number().over(early)).filter(F.col("rank") <= DIRECT_REFS).select("rule_id", "rank", "line")

    bullets = base.filter(F.col("line").startswith("- ["))
    scored = bullets.join(wanted.select("rule_id", "_scope", "_words"), "_scope").withColumn(
        "_score", F.size(F.filter("_words", lambda w: F.lower("line").contains(w)))
    ).filter(F.col("_score") > 0)
    best = Window.partitionBy("rule_id").orderBy(F.desc("_score"), "_part", "line_no")
    scored = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= KEYWORD_REFS).select("rule_id", "rank", "line")
    indirect = scored.join(direct.select("rule_id").distinct(), "rule_id", "left_anti")

    found = direct.unionByName(indirect)
    rows = rules.select("rule_id").join(found, "rule_id", "left")
    learned = F.col("line").isNotNull()
    marked = F.nullif(F.regexp_extract("line", LEARNING_LINE, 1), F.lit(""))
    return rows.select(
        "rule_id", F.coalesce("rank", F.lit(1)).alias("rank"),
        F.when(learned, "learnings").otherwise(fallback_source).alias("source"),
        F.coalesce(marked, F.col("rule_id")).alias("snippet_id"),
        F.col("line").alias("snippet"),
    )
