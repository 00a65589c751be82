"""Review views over the canonical tables.

``invoices`` are canonical summary rows (optionally enriched with web_view_link
and extra_values); ``results`` are canonical compliance rows; ``rules`` is the
rule configuration.  Everything per invoice is bounded by the rules of its type;
everything per rule is counted, and lists per rule stay in long form beyond a
fixed cell size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.blanks import text_or_empty
from ..functions.text import contains_any, display_text, join_distinct
from ..operators.scale import bounded_rows, grown, ordered

# Keyword lists of the consistency checks.
MISSING_TERMS = ("missing", "not identified", "no se ha identificado", "falta", "null", "required", "obligatorio")
GOODS_HINTS = (
    "purchase", "procurement", "supplier", "quotation", "quote", "bid", "flour", "wheat", "goods", "equipment",
    "consumable", "payment voucher",
)
NEGATED_GOODS = (
    "no procurement", "no supplier", "no quotation", "no quote", "no bid", "no flour", "no wheat", "no goods",
    "no equipment", "no consumable", "no payment voucher", "not procurement", "not supplier", "without procurement",
    "without supplier", "sin procurement", "sin proveedor", "sin cotizacion", "sin cotización",
)
TRAVEL_TYPE = "VIAJES"
TRAVEL_CONTRADICTION = "Invoice classified as travel but visible context suggests procurement or goods"
HIDDEN_RULE = "Configured compliance rule"

# Longest list shown in one rule-guide cell; longer ones stay in long form.


def result_status(status: Column) -> Column:
    low = F.lower(F.trim(text_or_empty(status)))
    # Looked up, so that the status is mentioned once: Catalyst copies it into every mention.
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(s) for s in S.RESULT_STATUSES for _ in "kv"]), low), F.lit("unknown"))


def is_action(status: Column) -> Column:
    return status.isin(*S.ACTION_STATUSES)


# -- rule labels ---------------------------------------------------------------

def rule_sources(rules: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Rule metadata; rules seen only in results take their first result row."""
    columns = ("rule_id", "invoice_type_id", "rule_name", "field_id", "check_type", "check_value", "severity",
               "agent_hint", "error_message")
    known = rules.select(*[text_or_empty(F.col(c)).alias(c) for c in columns]).withColumn("message", F.lit(""))
    if results is None:
        return known
    seen = ("invoice_type_id", "rule_name", "field_id", "severity", "message")
    extra = (
        results.filter(F.col("rule_id") != "")
        .join(known.select("rule_id"), "rule_id", "left_anti")
        .groupBy("rule_id")
        .agg(F.min(F.struct("invoice_id", *seen)).alias("_r"))
    )
    blank = F.lit("")
    picked = {c: F.col(f"_r.{c}") for c in seen}
    picked |= {c: blank for c in ("check_type", "check_value", "agent_hint", "error_message")}
    return known.unionByName(extra.withColumns(picked).select(*known.columns))


def condition_text(check_type: Column, check_value: Column) -> Column:
    kind, value = display_text(check_type), text_or_empty(check_value)
    both = (kind != "") & (value != "")
    return F.when(both, F.concat(kind, F.lit(": "), value)).otherwise(F.concat(kind, value))


def rule_labels(sources: DataFrame) -> DataFrame:
    """rule_id → visible label, disambiguated where a base name repeats."""
    base = F.coalesce(
        F.nullif(display_text(F.col("rule_name")), F.lit("")),
        F.nullif(display_text(F.col("message")), F.lit("")),
        F.lit("Rule"),
    )
    rows = sources.withColumn("_base", base)
    rows = rows.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy(F.lower("_base"))))
    context = F.coalesce(
        F.nullif(display_text(F.col("field_id")), F.lit("")),
        F.nullif(condition_text(F.col("check_type"), F.col("check_value")), F.lit("")),
    )
    label = F.when((F.col("_same") > 1) & context.isNotNull(), F.concat("_base", F.lit(" - "), context))
    return rows.select("rule_id", F.coalesce(label, F.col("_base")).alias("label"), "invoice_type_id")


def labelled(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Result rows with ``label`` and the normalised ``st``."""
    named = labels.select("rule_id", "label")
    return results.join(F.broadcast(named), "rule_id", "left").withColumns(
        {
            "label": F.coalesce("label", display_text(F.col("rule_name"))),
            "st": result_status(F.col("normalized_status")),
        }
    )


# -- row-level text ------------------------------------------------------------

def rule_haystack() -> Column:
    parts = [text_or_empty(F.col(c)) for c in ("label", "rule_name", "field_id", "message", "agent_notes")]
    return F.lower(F.concat_ws(" ", *parts))


def rule_topic(haystack: Column) -> Column:
    return (
        F.when(contains_any(haystack, ("currency", "moneda")), "currency")
        .when(contains_any(haystack, ("total", "amount", "importe", "gross", "net")), "amount")
        .otherwise("")
    )


def amount_fields(haystack: Column) -> Column:
    """Amount columns a rule talks about."""
    none = F.array().cast("array<string>")

    def named(terms, *fields) -> Column:
        return F.when(contains_any(haystack, terms), F.array(*[F.lit(f) for f in fields])).otherwise(none)

    return F.concat(
        named(("net", "base imponible"), "net_amount"),
        named(("tax", "vat", "iva", "impuesto"), "tax_amount"),
        named(("gross", "total", "importe"), "total_amount", "gross_amount"),
    )


def looks_missing(message: Column, notes: Column) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", text_or_empty(message), text_or_empty(notes))), MISSING_TERMS)


def goods_evidence(text: Column) -> Column:
    low = F.lower(text_or_empty(text))
    return ~contains_any(low, NEGATED_GOODS) & contains_any(low, GOODS_HINTS)


def policy_summary(policy_refs: Column) -> Column:
    """Readable policy references; raw rule ids never show."""

    def shown(part: Column) -> Column:
        def piece(name: str) -> Column:
            return F.nullif(F.get_json_object(part, f"$.{name}"), F.lit(""))

        snippet = piece("snippet_id")
        parts = F.concat_ws(" - ", F.when(~snippet.startswith("R_"), snippet),
                            F.coalesce(piece("title"), piece("name")), piece("source"))
        words = F.filter(F.split(part, r"\s+"), lambda w: w != "")
        plain = F.array_join(F.transform(words, lambda w: F.when(w.startswith("R_"), HIDDEN_RULE).otherwise(w)), " ")
        is_object = part.startswith("{") & F.get_json_object(part, "$").isNotNull()
        return F.when(is_object, F.coalesce(F.nullif(parts, F.lit("")), F.lit(HIDDEN_RULE))).otherwise(plain)

    return join_distinct(F.transform(F.split(text_or_empty(policy_refs), "; "), lambda p: shown(F.trim(p))))


def missing_critical_fields() -> Column:
    marks = [F.when(text_or_empty(F.col(n)) == "", F.lit(S.MISSING_LABELS[n])) for n in S.HIGH_VALUE_FIELDS]
    return F.filter(F.array(*marks), lambda m: m.isNotNull())


def source_url(columns: list[str]) -> Column:
    link = text_or_empty(F.col("web_view_link")) if "web_view_link" in columns else F.lit("")
    uri = text_or_empty(F.col("source_uri"))
    drive = (F.col("source_type") == "google_drive") & (text_or_empty(F.col("source_id")) != "")
    web = uri.startswith("http://") | uri.startswith("https://") | uri.startswith("file://")
    return (
        F.when(link != "", link)
        .when(drive, F.concat(F.lit("https://drive.google.com/file/d/"), "source_id", F.lit("/view")))
        .when(web, uri)
        .otherwise("")
    )


def recommended_action(blocking: Column, warning: Column, unknown: Column, missing: Column, contradicted: Column) -> Column:
    """Sentence for the reviewer; the first three are joined label texts."""
    fields = F.array_join(missing, "; ")
    has_missing = F.size(missing) > 0
    parts = F.concat_ws(
        "; ",
        F.when(blocking != "", F.concat(F.lit("confirm "), blocking)),
        F.when(warning != "", F.concat(F.lit("check "), warning)),
        F.when(unknown != "", F.concat(F.lit("review unchecked result for "), unknown)),
        F.when(has_missing, F.concat(F.lit("complete missing fields: "), fields)),
        F.when(contradicted, F.lit("resolve internal contradictions")),
    )

    def sentence(lead: str, body: Column) -> Column:
        return F.concat(F.lit(lead), body, F.lit("."))

    return (
        F.when((blocking != "") | contradicted, sentence("Block approval until reviewed: ", parts))
        .when(warning != "", sentence("Check warning before approval: ", parts))
        .when(unknown != "", sentence("Review unchecked rule result: ", parts))
        .when(has_missing, sentence("Complete missing invoice fields: ", fields))
        .otherwise("No action needed.")
    )


def review_priority(status: Column, blocking: Column, warning: Column, unknown: Column, missing: Column, contradicted: Column) -> Column:
    return (
        F.when(status.isin("error", "failed", "needs_review") | blocking | contradicted, 1)
        .when((status == "warning") | warning, 2)
        .when((status == "unknown") | unknown | missing, 3)
        .otherwise(4)
    )


# -- per-invoice facts ---------------------------------------------------------

def _labels_of(*statuses: str) -> Column:
    return join_distinct(F.collect_set(F.when(F.col("st").isin(*statuses), F.col("label"))))


def invoice_facts(invoices: DataFrame, results: DataFrame, labels: DataFrame, with_issues: bool = False) -> DataFrame:
    """Invoice rows with everything the views say about them, aggregated once; ``with_issues``, what ``review_issues`` shows too.

    Lists per invoice are bounded by the rule table: (invoice, rule) is unique.  Only rows in need of
    action say anything, so these alone are gathered, and meet the invoice's values as one row.
    """
    S.require_keys(invoices, ("invoice_id", "invoice_file", "invoice_type_id", "review_status"), "invoice row")
    S.require_keys(results, ("invoice_id", "rule_id", "rule_name", "normalized_status", "severity", "message"), "compliance row")
    if "extra_values" in invoices.columns:
        total = text_or_empty(F.try_element_at("extra_values", F.lit("total_amount")))
    else:
        total = F.lit("")
    # Names of the values an invoice states.
    stated = F.filter(F.array(*[F.when(value != "", F.lit(name)) for name, value in (
        ("currency", text_or_empty(F.col("currency"))), ("net_amount", text_or_empty(F.col("net_amount"))),
        ("tax_amount", text_or_empty(F.col("tax_amount"))), ("gross_amount", text_or_empty(F.col("gross_amount"))), ("total_amount", total),
    )]), lambda n: n.isNotNull())
    # Texts that many terms are looked for in are columns first: code that makes them for each term is too long for the JVM's compiler.
    rows = labelled(results, labels).filter(is_action(F.col("st"))).withColumns({"_hay": rule_haystack(), "_missing": looks_missing(F.col("message"), F.col("agent_notes"))})
    hay = F.col("_hay")
    rows = rows.withColumns({"_topic": rule_topic(hay), "_amounts": amount_fields(hay)})

    def doubt(lead: str, fields: Column) -> Column:
        return F.struct(F.concat(F.lit(lead), "label", F.lit(" still needs review")).alias("text"), fields.alias("fields"))

    row_doubt = F.when(F.col("_missing"), (
        F.when(F.col("_topic") == "currency", doubt("Currency value exists but ", F.array(F.lit("currency"))))
        .when(F.col("_topic") == "amount", doubt("Amount value exists but ", F.col("_amounts")))
    ))
    reason = F.struct(
        "rule_id", "message",
        F.concat("label", F.lit(": "), F.coalesce(F.nullif("message", F.lit("")), F.col("st"))).alias("text"),
    )
    source_text = F.struct("rule_id", F.concat_ws(" ", text_or_empty(F.col("agent_notes")), text_or_empty(F.col("evidence_refs"))).alias("text"))
    facts = rows.withColumn("_doubt", row_doubt).groupBy("invoice_id").agg(
        _labels_of("failed", "flagged").alias("blocking_rules"),
        _labels_of("warning").alias("warning_rules"),
        _labels_of("unknown").alias("unknown_rules"),
        F.count_if(F.col("st") == "unknown").alias("not_checked"),
        F.transform(F.array_sort(F.collect_list(reason)), lambda r: r["text"]).alias("_reasons"),
        F.collect_set("_doubt").alias("_doubts"),
        F.transform(F.array_sort(F.collect_list(source_text)), lambda r: r["text"]).alias("_source_text"),
        join_distinct(F.collect_set("source_page")).alias("source_page"),
        join_distinct(F.collect_set("evidence_refs")).alias("evidence_refs"),
        join_distinct(F.collect_set("policy_refs")).alias("policy_refs"),
        *([rule_issues(rows)] if with_issues else []),
    )
    none = F.array().cast("array<string>")
    # Rows of one invoice_id share their findings: each counts once per row, and what any of them states counts for all.
    same = Window.partitionBy("invoice_id")
    out = invoices.join(grown(facts), "invoice_id", "left").withColumns(
        {"_copies": F.count(F.lit(1)).over(same).cast("int"), "_stated": F.flatten(F.collect_list(stated).over(same))})

    def each_copy(texts: str) -> Column:
        return F.flatten(F.transform(texts, lambda t: F.array_repeat(t, F.col("_copies"))))

    travel = (F.upper("invoice_type_id") == TRAVEL_TYPE) & goods_evidence(F.array_join(each_copy("_source_text"), " "))
    contras = F.transform(F.filter("_doubts", lambda d: F.arrays_overlap(d["fields"], F.col("_stated"))), lambda d: d["text"])
    contradictions = F.array_sort(F.array_distinct(F.concat(
        F.coalesce(contras, none), F.when(travel, F.array(F.lit(TRAVEL_CONTRADICTION))).otherwise(none))))
    filled = ("blocking_rules", "warning_rules", "unknown_rules", "source_page", "evidence_refs", "policy_refs")
    return out.withColumns(
        {
            **{c: F.coalesce(c, F.lit("")) for c in filled},
            "not_checked": F.coalesce(F.col("not_checked") * F.col("_copies"), F.lit(0)),
            "_reasons": F.coalesce(each_copy("_reasons"), none),
            "contradiction_list": contradictions,
            "missing_list": missing_critical_fields(),
            "status_seen": F.coalesce(F.nullif(F.lower(F.trim(text_or_empty(F.col("review_status")))), F.lit("")), F.lit("unknown")),
        }
    ).drop("_doubts", "_source_text", "_stated", "_copies")


def _action_of_facts() -> Column:
    return recommended_action(
        F.col("blocking_rules"), F.col("warning_rules"), F.col("unknown_rules"), F.col("missing_list"),
        F.size("contradiction_list") > 0,
    )


def invoice_review_summary(facts: DataFrame) -> DataFrame:
    """Reviewer row per invoice."""
    return facts.withColumns(
        {
            "invoice_type": F.col("invoice_type_id"),
            "primary_action": _action_of_facts(),
            "missing_critical_fields": F.array_join("missing_list", "; "),
            "contradictions": F.array_join("contradiction_list", "; "),
            "not_checked_count": F.col("not_checked").cast("string"),
        }
    ).select(*[text_or_empty(F.col(c)).alias(c) for c in S.REVIEWER_SUMMARY])


def needs_attention() -> Column:
    return (
        F.col("status_seen").isin(*S.ATTENTION_STATUSES)
        | (F.col("blocking_rules") != "") | (F.col("warning_rules") != "") | (F.col("unknown_rules") != "")
        | (F.size("missing_list") > 0) | (F.size("contradiction_list") > 0)
    )


def review_queue(facts: DataFrame) -> DataFrame:
    """One row per invoice needing attention."""
    none = F.array().cast("array<string>")
    reasons = F.concat(
        F.when(F.col("status_seen") != "passed", F.array(F.concat(F.lit("review_status="), "status_seen"))).otherwise(none),
        "_reasons",
        F.when(F.size("missing_list") > 0,
               F.array(F.concat(F.lit("Missing critical fields: "), F.array_join("missing_list", "; ")))).otherwise(none),
        F.when(F.size("contradiction_list") > 0,
               F.array(F.concat(F.lit("Internal contradictions: "), F.array_join("contradiction_list", "; ")))).otherwise(none),
    )
    priority = review_priority(
        F.col("status_seen"), F.col("blocking_rules") != "", F.col("warning_rules") != "",
        F.col("unknown_rules") != "", F.size("missing_list") > 0, F.size("contradiction_list") > 0,
    )
    return facts.filter(needs_attention()).withColumns(
        {
            "priority": priority.cast("string"),
            "recommended_action": _action_of_facts(),
            **{c: F.lit("") for c in ("decision", "reviewer", "notes", "resolved_date")},
            "invoice_type": F.col("invoice_type_id"),
            "review_status": F.col("status_seen"),
            "review_reasons": F.array_join(reasons, "; "),
            "missing_critical_fields": F.array_join("missing_list", "; "),
            "contradictions": F.array_join("contradiction_list", "; "),
            "policy_summary": policy_summary(F.col("policy_refs")),
            "source_url": source_url(facts.columns),
        }
    ).select(*S.REVIEW_QUEUE)


def rule_issues(rows: DataFrame) -> Column:
    """List of what review issues show of an invoice's labelled rows in need of action, as an aggregate."""
    return F.collect_list(F.struct(
        "st", "label", "field_id", "severity", "message", "source_page", "evidence_refs", "policy_refs")).alias("_issues")


def review_issues(facts: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """Rule issues, missing-field issues and contradictions, one row each.

    Where ``facts`` bring the rule issues of their invoices along (``with_issues``), the results are not read again.
    """
    if "_issues" not in facts.columns:
        rows = labelled(results, labels).filter(is_action(F.col("st")))
        facts = facts.join(grown(rows.groupBy("invoice_id").agg(rule_issues(rows))), "invoice_id", "left")
    base = ("invoice_file", "invoice_type", "review_status", "source_url", "source_uri")
    context = facts.select(
        "invoice_file", F.col("invoice_type_id").alias("invoice_type"), F.col("status_seen").alias("review_status"),
        source_url(facts.columns).alias("source_url"), "source_uri", "missing_list", "contradiction_list", "_issues")
    none = F.array().cast("array<string>")
    shown = ("st", "label", "field_id", "severity", "message", "source_page", "evidence_refs", "policy_refs")

    def listed(kind: str, texts: str) -> Column:
        """Texts of a kind as issues, with the columns of a rule's."""
        return F.transform(texts, lambda t: F.struct(
            F.lit(kind).alias("kind"), *[(t if c == "label" else F.lit(None).cast("string")).alias(c) for c in shown]))

    ruled = F.transform("_issues", lambda r: F.struct(
        F.when(r["st"] == "unknown", "not_checked").when(r["st"] == "warning", "warning_rule").otherwise("blocking_rule").alias("kind"),
        *[r[c].alias(c) for c in shown]))
    all_issues = F.concat(
        F.coalesce(ruled, F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in ('kind', *shown))}>>")),
        listed("missing_critical_field", "missing_list"), listed("internal_contradiction", "contradiction_list"))
    issues = context.select(*base, F.explode(all_issues).alias("_i")).select(*base, F.col("_i.kind").alias("issue_type"), *[f"_i.{c}" for c in shown])
    kind, text = F.col("issue_type"), F.col("label")
    gap, clash = kind == "missing_critical_field", kind == "internal_contradiction"

    def own(name: str) -> Column:
        return F.when(kind == name, text).otherwise("")

    def by_kind(of_gap, of_clash, of_rule) -> Column:
        return F.when(gap, of_gap).when(clash, of_clash).otherwise(of_rule)

    return issues.withColumns(
        {
            **{c: F.lit("") for c in ("decision", "notes", "resolved_date")},
            "priority": F.when(kind.isin("blocking_rule", "internal_contradiction"), "1").when(kind == "warning_rule", "2").otherwise("3"),
            "severity": by_kind("warning", "error", F.coalesce(F.nullif("severity", F.lit("")), F.col("st"))),
            "recommended_action": by_kind(
                F.concat(F.lit("Complete missing invoice field: "), text, F.lit(".")),
                F.lit("Block approval until reviewed: resolve internal contradiction."),
                recommended_action(own("blocking_rule"), own("warning_rule"), own("not_checked"), none, F.lit(False))),
            "field": by_kind(text, "", text_or_empty(F.col("field_id"))),
            "rule": by_kind("", "", text),
            "issue": by_kind(F.concat(F.lit("Missing critical field: "), text), text, F.coalesce(F.nullif("message", F.lit("")), F.col("st"))),
            **{c: by_kind("", "", F.col(c)) for c in ("source_page", "evidence_refs")},
            "policy_summary": by_kind("", "", policy_summary(F.col("policy_refs"))),
        }
    ).select(*S.REVIEW_ISSUES)


def dashboard_cells(facts: DataFrame, results: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """What the dashboard counts: (section, metric, value), a row for each finding, with ``keys`` of its document."""
    status = F.coalesce(F.nullif("review_status", F.lit("")), F.lit("unknown"))
    action = (
        F.when((F.size("contradiction_list") > 0) | status.isin("needs_review", "failed", "error"), "Blocked / needs review")
        .when(status == "warning", "Warnings").when(status == "passed", "Passed").otherwise("Unknown")
    )
    rows = labelled(results, labels)

    invoice_side = facts.select(*keys, F.explode(F.concat(
        F.array(F.struct(F.lit("Action summary").alias("section"), F.lit("Invoices").alias("metric"), action.alias("value")),
                F.struct(F.lit("Invoice review").alias("section"), F.lit("Review status").alias("metric"), status.alias("value"))),
        F.transform("missing_list", lambda v: F.struct(
            F.lit("Missing critical fields").alias("section"), F.lit("Field").alias("metric"), v.alias("value"))),
        F.transform("contradiction_list", lambda v: F.struct(
            F.lit("Internal contradictions").alias("section"), F.lit("Finding").alias("metric"), v.alias("value"))),
    )).alias("_s")).select(*keys, "_s.*")
    none = F.array().cast("array<struct<section:string,metric:string,value:string>>")
    # A row counts once by its status and, in need of action, once more by its rule: both in one pass over the results.
    result_side = rows.select(*keys, F.explode(F.concat(
        F.array(F.struct(F.lit("Compliance status").alias("section"), F.lit("Rule results").alias("metric"), F.col("st").alias("value"))),
        F.when(is_action(F.col("st")), F.array(F.struct(
            F.lit("Rules needing attention").alias("section"), F.lit("Rule").alias("metric"), F.col("label").alias("value")))).otherwise(none),
    )).alias("_s")).select(*keys, "_s.*")
    return invoice_side.unionByName(result_side)


def dashboard_table(counted: DataFrame) -> DataFrame:
    """Counted cells and the legend."""
    counted = counted.select("section", "metric", "value", F.col("count").cast("string").alias("count"))
    legend = counted.sparkSession.createDataFrame(
        [("Legend", "Status", "not_checked", ""), ("Legend", "Status", "not_applicable", ""),
         ("Legend", "Issue", "internal_contradiction", "")], "section string, metric string, value string, count string")
    return counted.unionByName(legend).select(*S.DASHBOARD)


def dashboard(facts: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """Six grouped counts and a legend."""
    cells = dashboard_cells(facts, results, labels)
    return dashboard_table(cells.groupBy("section", "metric", "value").agg(F.count(F.lit(1)).alias("count")))


# -- per-rule views ------------------------------------------------------------

def rule_guide_entries(results: DataFrame) -> DataFrame:
    """Long form of the rule-guide lists: (rule_id, kind, entry), whole at any size."""
    st = result_status(F.col("normalized_status"))
    file = text_or_empty(F.col("invoice_file"))
    rows = results.select("rule_id", st.alias("st"), file.alias("file"), text_or_empty(F.col("message")).alias("message"))
    named = rows.filter(F.col("st").isin("failed", "flagged", "warning")).select(
        "rule_id", F.when(F.col("st") == "warning", "warning").otherwise("failing").alias("kind"),
        F.col("file").alias("entry"), F.lit("").alias("tie"),
    ).distinct()
    reasons = rows.filter(is_action(F.col("st"))).select(
        "rule_id", F.lit("reasoning").alias("kind"),
        F.concat(F.coalesce(F.nullif("file", F.lit("")), F.lit("invoice")), F.lit(": "),
                 F.coalesce(F.nullif("message", F.lit("")), F.col("st"))).alias("entry"),
        F.concat_ws("\u0001", "file", "st", "message").alias("tie"),
    )
    return named.unionByName(reasons)


def rule_guide(results: DataFrame, sources: DataFrame, labels: DataFrame) -> DataFrame:
    """Metadata and counts per rule; its lists of invoices and reasons are ``rule_guide_entries``."""
    st = result_status(F.col("normalized_status"))
    counts = results.groupBy("rule_id").agg(
        *[F.count_if(st == s).alias(s) for s in S.RESULT_STATUSES], F.count(F.lit(1)).alias("total_results")
    )
    rows = sources.join(labels.select("rule_id", "label"), "rule_id").join(counts, "rule_id", "left")
    return rows.withColumns(
        {
            "rule": F.col("label"), "invoice_type": F.col("invoice_type_id"), "field": F.col("field_id"),
            "condition": condition_text(F.col("check_type"), F.col("check_value")), "guidance": F.col("agent_hint"),
            "failure_message": F.coalesce(F.nullif("error_message", F.lit("")), F.col("message")),
            **{c: F.coalesce(c, F.lit(0)).cast("string") for c in (*S.RESULT_STATUSES, "total_results")},
        }
    ).select(*S.RULE_GUIDE)


def status_pivot(results: DataFrame) -> DataFrame:
    """Counts by rule name and status with row, column and grand totals."""
    return results.cube("rule_name", "normalized_status").agg(
        F.count(F.nullif(text_or_empty(F.col("invoice_id")), F.lit(""))).alias("invoices"),
        F.grouping_id().cast("int").alias("level"),
    )


def reject_ambiguous(results: DataFrame) -> DataFrame:
    """One cell per (invoice, rule); two different rows for one cell are an error.

    Rows go by invoice, once, as two hashes and the number of their status; pivots and joins by invoice follow in place.
    """
    whole = F.to_json(F.struct(*[F.col(c) for c in results.columns]))
    known = F.array(*[F.lit(s) for s in S.RESULT_STATUSES])
    marks = {"_a": F.xxhash64(whole), "_b": F.xxhash64(F.lit(1), whole),
             "_st": F.array_position(known, result_status(F.col("normalized_status"))).cast("tinyint")}
    rows = results.filter((F.col("invoice_id") != "") & (F.col("rule_id") != "")).select(
        "invoice_id", "rule_id", *[v.alias(n) for n, v in marks.items()])
    cells = rows.repartition("invoice_id").groupBy("invoice_id", "rule_id").agg(
        *[f(c).alias(f"{c}{n}") for c in ("_a", "_b") for n, f in ((0, F.min), (1, F.max))], F.max("_st").alias("_st"))
    clash = F.raise_error(F.concat(F.lit("duplicate compliance result for "), "invoice_id", F.lit("/"), "rule_id"))
    alike = (F.col("_a0") == F.col("_a1")) & (F.col("_b0") == F.col("_b1"))
    return cells.select(
        "invoice_id", "rule_id", F.when(alike, F.get(known, F.col("_st").cast("int") - 1)).otherwise(clash.cast("string")).alias("status")
    )


def missing_cell(invoice_type: Column, rule_type: Column) -> Column:
    other = (text_or_empty(rule_type) != "") & (text_or_empty(invoice_type) != "") & (rule_type != invoice_type)
    return F.when(other, "not_applicable").otherwise("not_checked")


def compliance_matrix_long(invoices: DataFrame, results: DataFrame, labels: DataFrame) -> DataFrame:
    """(invoice, rule, status) for every observed rule, gaps filled.

    The observed rules are a bounded configuration list; each invoice meets its cells as one map
    and fans out over the list afterwards, so the cells of the whole matrix are never shuffled.
    """
    seen = results.select("rule_id").filter("rule_id <> ''").distinct()
    listed = bounded_rows(labels.join(seen, "rule_id", "left_semi").select("rule_id", "label", "invoice_type_id"))
    entries = F.array(*[F.struct(F.lit(r[0]).alias("rule_id"), F.lit(r[1]).alias("label"), F.lit(r[2]).alias("rule_type")) for r in listed])
    told = reject_ambiguous(results).groupBy("invoice_id").agg(F.collect_list(F.struct("rule_id", "status")).alias("_told"))
    told = told.select("invoice_id", F.map_from_arrays("_told.rule_id", "_told.status").alias("_told"))
    met = invoices.select("invoice_id", "invoice_file", "invoice_type_id", "review_status").join(grown(told), "invoice_id", "left")
    wide = met.withColumn("_r", F.explode(entries)).select(*met.columns, "_r.*")
    return wide.withColumn("status", F.coalesce(
        F.try_element_at("_told", F.col("rule_id")), missing_cell(F.col("invoice_type_id"), F.col("rule_type")))).drop("_told")


def compliance_matrix(invoices: DataFrame, results: DataFrame, labels: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Pivot with one column per visible rule label.

    ``seen`` (rule_id) names the observed rules where the caller keeps them; else the results are read for them.

    Where rules share a label, a real verdict beats not_checked, which beats
    not_applicable; between verdicts the higher rule id wins.
    """
    if seen is None:
        seen = results.select("rule_id").filter("rule_id <> ''").distinct()
    listed = bounded_rows(labels.join(seen, "rule_id", "left_semi").select("rule_id", "label", "invoice_type_id"))
    names = sorted({r["label"] for r in listed}, key=lambda n: (n.lower(), n))
    types = {n: sorted({r["invoice_type_id"] or "" for r in listed if r["label"] == n}) for n in names}
    cells = reject_ambiguous(results).join(F.broadcast(labels.select("rule_id", "label")), "rule_id")
    pivoted = cells.groupBy("invoice_id").pivot("label", names).agg(F.max_by("status", "rule_id"))
    rows = invoices.select("invoice_id", "invoice_file", F.col("invoice_type_id").alias("invoice_type"), "review_status")
    rows = rows.join(grown(pivoted), "invoice_id", "left")

    def filled(name: str) -> Column:
        mine = F.col("invoice_type").isin(*types[name]) if "" not in types[name] else F.lit(True)
        gap = F.when(mine | (text_or_empty(F.col("invoice_type")) == ""), "not_checked").otherwise("not_applicable")
        return F.coalesce(F.col(f"`{name}`"), gap).alias(name)

    return rows.select(*S.MATRIX_KEYS, *[filled(n) for n in names])


def matrix_column_notes(guide: DataFrame) -> DataFrame:
    """Note text of each matrix column, from the rule guide."""
    parts = [F.nullif(text_or_empty(F.col(c)), F.lit("")) for c in ("severity", "condition", "guidance", "failure_message")]
    return guide.select(F.col("rule").alias("label"), F.concat_ws("\n", *parts).alias("note"))


# -- orders --------------------------------------------------------------------

def order_review_queue(queue: DataFrame) -> DataFrame:
    return ordered(queue, F.col("priority").cast("int"), "invoice_file", "blocking_rules", "warning_rules")


def order_review_issues(issues: DataFrame) -> DataFrame:
    return ordered(issues, F.col("priority").cast("int"), "invoice_file", "issue_type", "rule", "field")


def order_dashboard(cells: DataFrame) -> DataFrame:
    sections = ("Action summary", "Invoice review", "Compliance status", "Missing critical fields",
                "Internal contradictions", "Rules needing attention", "Legend")
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    return cells.orderBy(place, F.when(F.col("section") != "Legend", F.col("value")), F.desc("metric"), F.desc("value"))


def order_rule_guide(guide: DataFrame) -> DataFrame:
    return guide.orderBy(F.lower("rule"), "invoice_type")


def workbook(runs: DataFrame, field_results: DataFrame, rule_results: DataFrame, rules: DataFrame, evidence: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the workbook from document states."""
    from . import canonical as C

    summary = C.canonical_invoice_summary(runs, field_results, rule_results)
    results = C.canonical_compliance_results(runs, rule_results, field_results, evidence)
    invoices = C.enrich_invoices(summary, runs, field_results)
    sources = rule_sources(rules, results)
    facts = invoice_facts(invoices, results, rule_labels(sources))
    return workbook_tables(summary, results, facts, sources)


def workbook_tables(
    summary: DataFrame, results: DataFrame, facts: DataFrame, sources: DataFrame,
    counted: DataFrame | None = None, seen: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of the workbook from canonical rows and facts; dashboard counts and observed rules may be given."""
    labels = rule_labels(sources)
    return {
        "Dashboard": dashboard(facts, results, labels) if counted is None else dashboard_table(counted),
        "Review": review_queue(facts),
        "Review Issues": review_issues(facts, results, labels),
        "Invoice Summary": invoice_review_summary(facts),
        "Compliance Matrix": compliance_matrix(summary, results, labels, seen),
        "Rule Guide": rule_guide(results, sources, labels),
        "Rule Guide Entries": rule_guide_entries(results).select(*S.RULE_GUIDE_ENTRIES),
        "Compliance Results": results,
        "Technical Run Data": summary,
    }
