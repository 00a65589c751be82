"""Configuration-driven rule checks: documents joined to rules by type, one CASE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import is_blank
from ..functions.numbers import float_text, rule_number
from .expressions import evaluate, names_in, postfix
from .scale import grown, join_inside

# Tolerances and result wording.
CROSS_FIELD_TOLERANCE = 0.02
PASS_MESSAGE = "OK"
VISUAL_PENDING = "Visual check — call check_compliance_visual(image_path, page_num) to evaluate"
NO_OBSERVATION = "No observation"
NO_VERDICT_CONFIDENCE = 0.5
CHECK_TYPES = (
    "required", "regex", "range", "enum", "cross_field", "conditional_check", "required_one_of", "visual_check",
)

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _listed(field_results: DataFrame) -> DataFrame:
    """Fields of each document, gathered once; ``value_num`` is the number of a typed decimal."""
    typed = "value_num" in field_results.columns
    value = F.struct(
        F.col("value_text").alias("text"),
        (F.col("value_num") if typed else F.lit(None)).cast("double").alias("num"),
        F.col("source_page").alias("page"),
    )
    return field_results.groupBy("doc_id").agg(F.collect_list(F.struct("field_name", value.alias("value"), "field_id")).alias("_f"))


def _maps() -> tuple[Column, Column]:
    """name → (text, num, page) and id → name, both cut from the one list."""
    names = F.arrays_zip(F.col("_f.field_id").alias("field_id"), F.col("_f.field_name").alias("field_name"))
    return F.map_from_arrays("_f.field_name", "_f.value").alias("_values"), F.map_from_entries(F.sort_array(names)).alias("_names")


def field_map(field_results: DataFrame) -> DataFrame:
    """One row per document with name → (text, num, page) and id → name maps.

    (doc_id, field_name) is unique, so the size of a map is bounded by the field schema, not by the data.
    """
    return _listed(field_results).select("doc_id", *_maps())


def document_facts(documents: DataFrame, field_results: DataFrame) -> DataFrame:
    """Typed documents with their field maps.

    Fields that a join by document left together are gathered in place, and what comes out is dealt and sorted by
    doc_id, so that rules fanned out over it meet other rows of the document without a shuffle. The fields
    without a doc_id are those of the documents without one.
    """
    typed = documents.groupBy("doc_id").agg(F.max("invoice_type_id").alias("invoice_type_id")).where("invoice_type_id is not null")
    stray = _listed(field_results.where("doc_id is null")).select(F.lit(True).alias("_stray"), F.col("_f").alias("_stray_f"))
    met = typed.join(grown(_listed(field_results)), "doc_id", "left")
    met = met.join(F.broadcast(stray), F.col("doc_id").isNull() == F.col("_stray"), "left")  # a row at most
    nothing = F.array().cast(met.schema["_f"].dataType)
    return met.withColumn("_f", F.coalesce("_f", "_stray_f", nothing)).select("doc_id", "invoice_type_id", *_maps())


def _value(name: Column) -> Column:
    return F.try_element_at("_values", name)


def _text(value: Column) -> Column:
    """Text that a check compares: a typed decimal in its number form."""
    return F.coalesce(float_text(value["num"]), value["text"])


def _number(value: Column) -> Column:
    return F.coalesce(value["num"], rule_number(value["text"]))


def _resolved(field_id: Column) -> Column:
    """Field name behind an id; an unknown id is taken as a name."""
    return F.coalesce(F.try_element_at("_names", field_id), field_id)


def _cross_field(rows: DataFrame) -> DataFrame:
    """Both readings of each rule's arithmetic and the names without a number.

    A name with ``rate`` in a product may be a percentage, so it is tried as it is and divided by 100.
    """
    here = F.col("check_type") == "cross_field"

    def raw(name: Column) -> Column:
        return F.try_element_at("_operands", name)

    def percent(name: Column) -> Column:
        return F.when(F.col("_product") & name.contains("rate") & (raw(name) > 1), raw(name) / 100.0).otherwise(raw(name))

    unscaled = evaluate("_postfix", raw)
    return rows.withColumns({
        "_num": F.when(here | (F.col("check_type") == "range"), _number(F.col("_found"))),
        "_missing": F.when(here, F.filter("_mentioned", lambda n: raw(n).isNull())),
        "_unscaled": F.when(here, unscaled),
        "_scaled": F.when(here, F.when(F.col("_product") & F.exists("_mentioned", lambda n: n.contains("rate")), evaluate("_postfix", percent)).otherwise(unscaled)),
    })


def _read_values(rows: DataFrame) -> DataFrame:
    """Rows of (document, rule) with what the rule reads of the document's maps, without the maps.

    The maps hold every field of the document and each later step would copy them once per rule.
    """
    def only(kind: str, value: Column) -> Column:
        return F.when(F.col("check_type") == kind, value)

    alternatives = F.concat(F.array("field_id"), F.col("_list"))
    return rows.withColumns({
        "_found": _value(_resolved(F.col("field_id"))),
        "_operands": only("cross_field", F.map_from_arrays("_mentioned", F.transform("_mentioned", lambda n: _number(_value(n))))),
        "_condition": only("conditional_check", _value(F.col("_if")[0])),
        "_consequence": only("conditional_check", _value(F.col("_then")[0])),
        "_any_filled": only("required_one_of", F.exists(alternatives, lambda item: ~is_blank(_value(_resolved(item))["text"]))),
    }).drop("_values", "_names")


def _prepared(rules: DataFrame, fields: DataFrame | None) -> DataFrame:
    """Per-rule parsing done once per rule, not once per document."""
    parts = F.split("check_value", ",")
    sides = F.split("check_value", " then ")
    when_ = F.split(F.trim(F.replace(sides[0], F.lit("if "), F.lit(""))), "=")
    then_ = F.split(F.trim(F.get(sides, F.lit(1))), "=")
    cross = F.col("check_type") == "cross_field"
    number_bounds = (F.size(parts) == 2) & parts[0].rlike(_NUMBER) & F.get(parts, F.lit(1)).rlike(_NUMBER)
    staged = rules.withColumns(
        {
            "_lo": F.when(number_bounds, F.trim(parts[0]).try_cast("double")),
            "_hi": F.when(number_bounds, F.trim(F.get(parts, F.lit(1))).try_cast("double")),
            "_list": F.transform(parts, lambda p: F.trim(p)),
            "_if": F.when((F.size(when_) == 2) & (F.size(then_) == 2), F.transform(when_, lambda p: F.trim(p))),
            "_then": F.when((F.size(when_) == 2) & (F.size(then_) == 2), F.transform(then_, lambda p: F.trim(p))),
            "_postfix": F.when(cross, postfix(F.col("check_value"))),
            "_mentioned": F.when(cross, names_in(F.col("check_value"))),
            "_product": F.col("check_value").contains("*"),
        }
    )
    if fields is None:
        return staged.withColumn("_required", F.lit(True))
    known = fields.groupBy("field_id").agg(F.max("required").alias("_known"))
    return staged.join(known, "field_id", "left").withColumn(
        "_required", F.coalesce("_known", F.lit(True))
    ).drop("_known")


def evaluate_rules(
    documents: DataFrame,
    field_results: DataFrame,
    rules: DataFrame,
    fields: DataFrame | None = None,
    prior_results: DataFrame | None = None,
) -> DataFrame:
    """Verdict per (document, rule of its type).

    documents: doc_id, invoice_type_id.  field_results: doc_id, field_id, field_name, value_text,
    source_page and, for typed decimals, value_num.  With ``prior_results``, earlier passed or failed
    verdicts of any kind are kept and only the rest is evaluated.  Rules are data: the rule table, which is
    configuration, is broadcast, so documents are not dealt out by their few types; building the plan runs no job.
    """
    rows = document_facts(documents, field_results).join(F.broadcast(_prepared(rules, fields)), "invoice_type_id")
    if prior_results is not None:
        settled = prior_results.filter(F.col("status").isin("passed", "failed"))
        rows = join_inside(rows, settled.select("doc_id", "rule_id"), "doc_id", ["rule_id"], "left_anti")

    out = _cross_field(_read_values(rows)).withColumn("_v", _verdict()).select(
        "doc_id", "invoice_type_id", "rule_id", "rule_name", "field_id", "check_type",
        F.col("_v.status").alias("status"), "severity", F.col("_v.message").alias("message"),
        F.lit(None).cast("string").alias("agent_notes"), F.col("_v.skip_kind").alias("skip_kind"),
        "rule_order",
    )
    if prior_results is None:
        return out
    kept = settled.select(
        "doc_id", "rule_id", "rule_name", "field_id", "status", "severity", "message", "agent_notes", "skip_kind"
    ).join(F.broadcast(rules.select("rule_id", "invoice_type_id", "check_type", "rule_order")), "rule_id")
    kept = join_inside(kept, documents.select("doc_id", "invoice_type_id"), "doc_id", ["invoice_type_id"], "left_semi")
    return out.unionByName(kept.select(*out.columns))


def _outcome(status: str, message: Column | str, skip_kind: str | None = None) -> Column:
    return F.struct(
        F.lit(status).alias("status"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"),
        F.lit(skip_kind).cast("string").alias("skip_kind"),
    )


def _verdict() -> Column:
    found, num = F.col("_found"), F.col("_num")
    # A number's text is written where a check shows or compares it, and is never blank.
    text, blank = _text(found), found["num"].isNull() & is_blank(found["text"])
    need = F.col("_required")
    passed = _outcome("passed", PASS_MESSAGE)
    failed = _outcome("failed", F.coalesce("error_message", F.lit("")))

    def say(message: str | Column) -> Column:
        return _outcome("failed", message)

    def skip(message: str | Column) -> Column:
        return _outcome("skipped", message, "missing")

    def test(condition: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), passed).otherwise(failed)

    def absent(kind: str, missing_message) -> Column:
        return F.when(need, say(missing_message)).otherwise(
            skip(f"Value missing/null — skipping {kind} check")
        )

    regex = F.when(
        blank, absent("regex", F.concat(F.lit("Value is null/missing, cannot match pattern "), "check_value"))
    ).otherwise(test(F.regexp_like(text, F.concat(F.lit("^(?:"), "check_value", F.lit(")")))))

    usable = num.isNotNull() & F.col("_lo").isNotNull()
    range_ = (
        F.when(blank, absent("range", "Value is null/missing, cannot run range check"))
        .when(usable, test(num.between(F.col("_lo"), F.col("_hi"))))
        .when(need, say(F.concat(F.lit("Could not parse value '"), text, F.lit("' as number for range check"))))
        .otherwise(
            skip(F.concat(F.lit("Unparseable numeric value '"), text, F.lit("' — skipped for optional field")))
        )
    )

    listed = F.transform("_list", lambda item: F.upper(item))
    enum = F.when(blank, absent("enum", "Value is null/missing, cannot run enum check")).otherwise(
        test(F.array_contains(listed, F.upper(F.trim(text))))
    )

    def near(expected: Column) -> Column:
        return F.coalesce(F.abs(expected - num) <= CROSS_FIELD_TOLERANCE, F.lit(False))

    scaled, unscaled = F.col("_scaled"), F.col("_unscaled")
    lead = "Cross-field check skipped (missing values): "
    cross = (
        F.when(
            F.size("_missing") > 0,
            skip(F.concat(F.lit(lead + "Missing extracted values for field(s): "), F.array_join("_missing", ", "))),
        )
        .when(scaled.isNull() | unscaled.isNull(), skip(lead + "expression cannot be evaluated"))
        .when(num.isNull(), skip(F.concat(F.lit(lead + "Could not parse actual value '"),
                                          F.coalesce(text, F.lit("None")), F.lit("' as number"))))
        .when(near(scaled) | near(unscaled), passed)
        .otherwise(say(F.format_string(
            "Expected ~%.2f (scaled) or ~%.2f (unscaled), got %.2f", scaled, unscaled, num)))
    )

    condition_value = F.lower(F.coalesce(_text(F.col("_condition")), F.lit("None")))
    then_value = F.col("_consequence")
    then_text = _text(then_value)
    then_want = F.lower(F.col("_then")[1])
    zero = F.coalesce(then_value["num"] == 0, then_text == "0")
    then_ok = (
        F.when(then_want.isin("null", "none"), then_text.isNull() | then_text.isin("null", "") | zero)
        .when(then_want == "0", then_text.isNull() | zero)
        .otherwise(F.lower(F.coalesce(then_text, F.lit("None"))) == then_want)
    )
    conditional = (
        F.when(F.col("_if").isNull(), skip("Conditional check skipped: malformed condition"))
        .when(condition_value != F.lower(F.col("_if")[1]), skip("Condition not met, rule skipped"))
        .otherwise(test(then_ok))
    )

    one_of = test(F.col("_any_filled"))

    return (
        F.when(F.col("check_type") == "visual_check", _outcome("skipped", VISUAL_PENDING, "visual"))
        .when(F.col("check_type") == "required", test(~blank))
        .when(F.col("check_type") == "regex", regex)
        .when(F.col("check_type") == "range", range_)
        .when(F.col("check_type") == "enum", enum)
        .when(F.col("check_type") == "cross_field", cross)
        .when(F.col("check_type") == "conditional_check", conditional)
        .when(F.col("check_type") == "required_one_of", one_of)
        .otherwise(skip(F.concat(F.lit("Unknown check_type: "), "check_type")))
    )


def merge_visual_verdicts(rule_results: DataFrame, verdicts: DataFrame, page_num: Column | None = None) -> DataFrame:
    """Replace the placeholders of visual rules by their verdicts.

    ``verdicts`` has one row per evaluated (doc_id, rule_id); absent parts of a
    verdict count as a failure with confidence 0.5 and no observation.
    """
    told = verdicts.select(
        "doc_id", "rule_id", F.lit(True).alias("_told"),
        F.coalesce("passes", F.lit(False)).alias("_passes"),
        F.coalesce("confidence", F.lit(NO_VERDICT_CONFIDENCE)).alias("_conf"),
        F.coalesce("observation", F.lit(NO_OBSERVATION)).alias("_obs"),
        F.col("page_num").alias("_page"),
    )
    joined = join_inside(rule_results, told, "doc_id", ["rule_id"])
    replace = (F.col("check_type") == "visual_check") & F.col("_told").isNotNull()
    notes = F.format_string("visual check page %d, confidence=%.2f", "_page", "_conf")
    return joined.withColumns(
        {
            "status": F.when(replace, F.when(F.col("_passes"), "passed").otherwise("failed")).otherwise(F.col("status")),
            "message": F.when(replace, F.col("_obs")).otherwise(F.col("message")),
            "agent_notes": F.when(replace, notes).otherwise(F.col("agent_notes")),
            "skip_kind": F.when(~replace, F.col("skip_kind")),
        }
    ).drop("_told", "_passes", "_conf", "_obs", "_page")


def is_failed(severity: str) -> Column:
    return (F.col("status") == "failed") & (F.col("severity") == severity)


def ordered_ids(condition: Column) -> Column:
    """Rule ids in rule order; one document has at most as many as it has rules."""
    picked = F.array_sort(F.collect_list(F.when(condition, F.struct("rule_order", "rule_id"))))
    return F.transform(picked, lambda p: p["rule_id"])


def rule_verdict_summary(rule_results: DataFrame) -> DataFrame:
    """Passed count and failed rule ids per document, split by severity."""
    return rule_results.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rules_total"),
        F.count_if(F.col("status") == "passed").alias("passed_count"),
        ordered_ids(is_failed("error")).alias("error_failed_rule_ids"),
        ordered_ids(is_failed("warning")).alias("warning_failed_rule_ids"),
    )


def compliance_report(rule_results: DataFrame) -> DataFrame:
    """Totals per document and whether every blocking matter is settled."""
    skipped = F.col("status") == "skipped"
    visual = skipped & (F.col("skip_kind") == "visual")
    missing = skipped & (F.col("skip_kind") == "missing")
    blocked = is_failed("error") | visual | (missing & (F.col("severity") == "error"))
    return rule_results.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(F.col("status") == "passed").alias("passed"),
        ordered_ids(is_failed("error")).alias("failed_errors"),
        ordered_ids(is_failed("warning")).alias("failed_warnings"),
        ordered_ids(missing).alias("skipped_checks"),
        ordered_ids(visual).alias("visual_checks_pending"),
        (F.count_if(blocked) == 0).alias("all_errors_resolved"),
    )


def rule_state(status: Column, has_policy: Column) -> Column:
    return (
        F.when(status == "passed", F.when(has_policy, "finalized_pass").otherwise("needs_review"))
        .when(status == "failed", "finalized_fail")
        .when(status == "skipped", "candidate")
    )


def finish_status(rule_results: DataFrame, field_results: DataFrame, documents: DataFrame) -> DataFrame:
    """Final run status per document.

    ``rule_results`` carries missing_slots (array) and rule_state beside the
    verdict.  A finish is refused while visual rules are pending, or when a
    typed document has neither verdicts nor any extracted value.
    """
    unsettled = (
        (F.col("severity") == "error")
        & (F.col("status") != "passed")
        & ((F.size("missing_slots") > 0)
           | ~F.coalesce(F.col("rule_state"), F.lit("")).isin("finalized_pass", "finalized_fail"))
    )
    per_rules = rule_results.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("_rules"),
        F.count_if((F.col("status") == "skipped") & (F.col("skip_kind") == "visual")).alias("_pending"),
        F.count_if(is_failed("error")).alias("_failed"),
        F.count_if((F.col("status") == "skipped") & (F.col("severity") == "error")).alias("_skipped"),
        F.count_if(unsettled).alias("_unsettled"),
        F.count_if(is_failed("warning")).alias("_warned"),
    )
    per_fields = field_results.groupBy("doc_id").agg(
        F.count("value_text").alias("_extracted"),
        F.count_if(F.coalesce("flagged_for_review", F.lit(False))).alias("_flags"),
    )
    rows = documents.select("doc_id", "invoice_type_id").join(grown(per_rules), "doc_id", "left").join(
        grown(per_fields), "doc_id", "left"
    )
    count = {c: F.coalesce(c, F.lit(0)) for c in
             ("_rules", "_pending", "_failed", "_skipped", "_unsettled", "_warned", "_extracted", "_flags")}
    empty_run = (
        (F.coalesce("invoice_type_id", F.lit("")) != "") & (count["_rules"] == 0) & (count["_extracted"] == 0)
    )
    finished = ~((count["_pending"] > 0) | empty_run)
    resolved = (count["_failed"] + count["_skipped"] + count["_unsettled"]) == 0
    status = F.when(count["_flags"] > 0, "needs_review").when(resolved, "passed").otherwise("failed")
    why = (
        F.when(~resolved, "Run status reflects blocking error-severity rule failures or incomplete error evidence.")
        .when(count["_warned"] > 0,
              "No blocking error-severity failures; warning-level rules may still be non-pass "
              "(listed in warning_failures).")
        .when(count["_flags"] > 0, "No rule blockers; one or more fields are flagged for human review.")
        .otherwise("All evaluated rules passed at error severity; no flags.")
    )
    return rows.select(
        "doc_id", finished.alias("finished"),
        F.when(finished, status).otherwise("running").alias("status"),
        F.when(finished, why).alias("status_explanation"),
        (count["_failed"] > 0).alias("error_failed"),
        (count["_skipped"] > 0).alias("error_skipped"),
        (count["_unsettled"] > 0).alias("unresolved_error_evidence"),
    )


def remaining_gaps(rule_results: DataFrame) -> DataFrame:
    """Field names a document still lacks, read from its skip messages."""
    tail = F.regexp_extract("message", r"(?s)(?:field\(s\):|missing values\):)(?!.*field\(s\):)(.*)$", 1)
    names = F.transform(F.split(F.replace(tail, F.lit("."), F.lit("")), ","), lambda n: F.trim(n))
    return (
        rule_results.filter((F.col("status") == "skipped") & (F.col("skip_kind") == "missing"))
        .select("doc_id", F.explode(names).alias("field_name"))
        .filter((F.col("field_name") != "") & ~F.col("field_name").contains(" "))
        .distinct()
    )


