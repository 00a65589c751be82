"""Quality and guard metrics over execution logs.

Logs are ordered by an integer ``seq`` that is unique within a run.  All ordered
metrics are prefix aggregates (see ``scale.running``), so one run holding most
of the log is still processed in chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import text_or_empty
from .scale import Prefix, running

# Parameter aliases, tool contracts and guard thresholds.
PARAM_ALIASES = {
    "image_path": ("image_path", "page_path", "page_image_path", "image", "path", "file_path", "page_file"),
    "page_num": ("page_num", "page_index", "page"),
    "field_subset": ("field_subset", "fields", "field_names", "regions"),
    "region": ("region",),
    "hints": ("hints",),
    "package": ("package",),
}
TOOL_PARAMS = {
    "inspect_file": (), "compress_pages": ("dpi", "quality", "max_width"), "classify_document_type": (),
    "convert_pdf_to_images": ("dpi",), "crop_region": ("page_num", "region", "custom_bbox", "image_path"),
    "extract_fields_vision": ("page_num", "region", "hints", "field_subset", "fields", "field_names"),
    "check_compliance": (), "check_compliance_visual": ("page_num",),
    "flag_for_human_review": ("field_name", "fields", "fields_to_flag", "reason"),
    "flag_fields_for_review": ("field_name", "fields", "fields_to_flag", "reason"), "inventory_pages": (),
    "install_package": ("package",), "note": ("text",), "read_learnings": (),
    "write_learning": ("invoice_type_id", "category", "content"),
    "edit_learning": ("learning_id", "id", "new_content", "content"), "delete_learning": ("learning_id", "id"),
    "finish": ("reason", "all_errors_resolved"),
}
REQUIRED_PARAMS = {
    "extract_fields_vision": "page_num", "check_compliance_visual": "page_num", "crop_region": "region",
    "install_package": "package", "note": "text",
}
# A crop names its page or its image.
CROP_TOOL, CROP_SOURCES = "crop_region", ("page_num", "image_path")
EXEMPT_TOOL = "check_compliance"
WARN_REPEATS, STOP_REPEATS = 2, 5
MAX_FAILURES = 3
ESCALATE_FROM = 2
SAME_RESULT_GUARD = 2
REDUNDANT_TURNS = 3
NULL_REPEATS = 2


def _json(params: Column, key: str) -> Column:
    return F.get_json_object(params, f"$.{key}")


def _truthy(text: Column) -> Column:
    return F.when(~text.isin("", "0", "0.0", "[]", "{}", "false"), text)


def canonical_params(params: Column) -> Column:
    """Struct of logical parameters, first filled alias each."""
    return F.struct(*[
        F.coalesce(*[_truthy(_json(params, a)) for a in aliases]).alias(name) for name, aliases in PARAM_ALIASES.items()
    ])


def signature(tool: Column, params: Column) -> Column:
    return F.concat(tool, F.lit("|"), F.to_json(canonical_params(params)))


def page_number(raw: Column) -> Column:
    """First whole number of a loosely typed page argument, else 1."""
    first = F.substring_index(F.regexp_replace(text_or_empty(raw), r'^\[|\]$', ""), ",", 1)
    return F.coalesce(F.regexp_replace(first, r"[^\d]", "").try_cast("int"), F.lit(1))


def validate_actions(log: DataFrame) -> DataFrame:
    """Contract error of each action, null when valid."""
    allowed = F.create_map(*[
        part for tool, names in TOOL_PARAMS.items()
        for part in (F.lit(tool), F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>"))
    ])
    needed = F.create_map(*[F.lit(x) for pair in REQUIRED_PARAMS.items() for x in pair])
    mine = F.try_element_at(allowed, F.col("tool"))
    given = F.coalesce(F.json_object_keys("params"), F.array().cast("array<string>"))
    extra = F.array_sort(F.array_except(given, mine))
    must = F.try_element_at(needed, F.col("tool"))

    def shown(names: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))

    tool = F.concat(F.lit("Tool '"), "tool", F.lit("'"))
    error = (
        F.when(F.col("tool").isNull() | F.col("params").isNull() | F.col("reasoning").isNull(), "Missing required key.")
        .when(mine.isNull(), F.concat(F.lit("Unknown tool '"), "tool", F.lit("'.")))
        .when(F.json_object_keys("params").isNull(), "params must be a JSON object.")
        .when(F.size(extra) > 0, F.concat(tool, F.lit(" has invalid params: "), shown(extra), F.lit(". Allowed: "), shown(mine)))
        .when((F.col("tool") == CROP_TOOL) & ~F.arrays_overlap(given, F.array(*[F.lit(p) for p in CROP_SOURCES])),
              F.concat(tool, F.lit(" requires either "), F.lit(" or ".join(f"'{p}'" for p in CROP_SOURCES)), F.lit(".")))
        .when(must.isNotNull() & ~F.array_contains(given, must), F.concat(tool, F.lit(" requires '"), must, F.lit("'.")))
    )
    return log.withColumn("contract_error", error)


def numbered(log: DataFrame) -> DataFrame:
    """Dense turn number per run, from 0."""
    return running(log, ["run_id"], "seq", [Prefix("turn", "sum", F.lit(1), inclusive=False)]).withColumn(
        "turn", F.coalesce("turn", F.lit(0)).cast("bigint"))


def duplicate_action_streak(log: DataFrame, exempt: str = EXEMPT_TOOL) -> DataFrame:
    """Repeats of the very same call, with warn/stop signals.

    The exempt tool zeroes the streak but leaves the remembered call in place.
    """
    sig = F.when(F.col("tool") != exempt, signature(F.col("tool"), F.col("params")))
    rows = running(log.withColumn("_sig", sig), ["run_id"], "seq", [
        Prefix("_prev", "last", F.col("_sig"), inclusive=False), Prefix("_row", "sum", F.lit(1)),
    ])
    repeat = F.coalesce(F.col("_sig") == F.col("_prev"), F.lit(False))
    rows = running(rows, ["run_id"], "seq", [Prefix("_from", "last", F.when(~repeat, F.col("_row")))])
    streak = F.col("_row") - F.col("_from")
    signal = F.when(F.col("tool") == exempt, None).when(streak >= STOP_REPEATS, "stop").when(streak >= WARN_REPEATS, "warn")
    return rows.withColumns({"streak": streak, "signal": signal}).drop("_sig", "_prev", "_row", "_from")


def consecutive_failures(log: DataFrame) -> DataFrame:
    """Failures in a row per tool, and the sum of all tools' current counts."""
    ok = F.col("success")
    rows = running(log, ["run_id", "tool"], "seq", [Prefix("_n", "sum", F.lit(1))])
    rows = running(rows, ["run_id", "tool"], "seq", [
        Prefix("_ok", "last", F.when(ok, F.col("_n"))), Prefix("_ok_before", "last", F.when(ok, F.col("_n")), inclusive=False),
    ])
    failures = F.col("_n") - F.coalesce("_ok", F.lit(0))
    broken = F.col("_n") - 1 - F.coalesce("_ok_before", F.lit(0))
    rows = rows.withColumns({"failures": failures, "_delta": F.when(ok, -broken).otherwise(F.lit(1))})
    rows = running(rows, ["run_id"], "seq", [Prefix("total_failures", "sum", F.col("_delta"))])
    return rows.withColumns(
        {"stop": F.col("failures") >= MAX_FAILURES, "escalate": F.col("total_failures") >= ESCALATE_FROM}
    ).drop("_n", "_ok", "_ok_before", "_delta")


def compliance_repeats(log: DataFrame, tool: str = EXEMPT_TOOL) -> DataFrame:
    """Same-result streak of the compliance check and redundant calls.

    ``log`` carries turn, result_hash and ``updates`` (an extraction changed
    fields, which resets the streak).
    """
    check = F.col("tool") == tool
    rows = running(log, ["run_id"], "seq", [
        Prefix("_hash", "last", F.when(check, F.col("result_hash")), inclusive=False),
        Prefix("_turn", "last", F.when(check, F.col("turn")), inclusive=False),
    ])
    same = check & F.coalesce(F.col("result_hash") == F.col("_hash"), F.lit(False))
    rows = rows.withColumn("_same", F.when(same, 1).otherwise(0))
    rows = running(rows, ["run_id"], "seq", [Prefix("_cum", "sum", F.col("_same"))])
    reset = (check & (F.col("_same") == 0)) | F.coalesce(F.col("updates"), F.lit(False))
    rows = running(rows, ["run_id"], "seq", [Prefix("_base", "max", F.when(reset, F.col("_cum")))])
    streak = F.col("_cum") - F.coalesce("_base", F.lit(0))
    return rows.filter(check).withColumns(
        {
            "same_result_streak": streak, "loop_guard": streak >= SAME_RESULT_GUARD,
            "redundant": (F.col("_same") == 1) & (F.col("turn") - F.col("_turn") <= REDUNDANT_TURNS),
        }
    ).drop("_hash", "_turn", "_same", "_cum", "_base")


def null_only_extractions(log: DataFrame) -> DataFrame:
    """n-th null-only extraction of the same page and fields."""
    key = F.to_json(F.struct(
        _json(F.col("params"), "page_num").alias("page_num"),
        canonical_params(F.col("params"))["field_subset"].alias("field_subset")))
    rows = log.filter("null_only").withColumn("null_key", key)
    rows = running(rows, ["run_id", "null_key"], "seq", [Prefix("occurrence", "sum", F.lit(1))])
    return rows.withColumn("alert", F.col("occurrence") >= NULL_REPEATS)


def token_cap(calls: DataFrame, cap: int, warn_at: int) -> DataFrame:
    """Cumulative tokens, calls over the cap, and the single warning call."""
    rows = running(calls, ["run_id"], "seq", [Prefix("cumulative_tokens", "sum", F.col("tokens"))])
    total = F.col("cumulative_tokens")
    over = total > cap if cap > 0 else F.lit(False)
    reaches = (total >= warn_at) & (total - F.col("tokens") < warn_at) if warn_at > 0 else F.lit(False)
    return rows.withColumns({"over_cap": over, "warns": reaches & ~over})


def request_caps(calls: DataFrame, all_cap: int, chat_cap: int, generate_cap: int) -> DataFrame:
    """Calls refused because earlier calls already used up a cap."""
    kind = F.col("kind")
    rows = running(calls, ["run_id"], "seq", [
        Prefix("_all", "sum", F.lit(1), inclusive=False),
        Prefix("_chat", "sum", F.when(kind == "chat", 1).otherwise(0), inclusive=False),
        Prefix("_gen", "sum", F.when(kind == "generate", 1).otherwise(0), inclusive=False),
    ])

    def full(column: str, cap: int) -> Column:
        return (F.coalesce(column, F.lit(0)) >= cap) if cap > 0 else F.lit(False)

    rejected = full("_all", all_cap) | ((kind == "chat") & full("_chat", chat_cap)) | ((kind == "generate") & full("_gen", generate_cap))
    return rows.withColumn("rejected", rejected).drop("_all", "_chat", "_gen")


def usage_tokens(raw: Column) -> Column:
    """Total tokens of a response: first readable of the known JSON paths."""

    def num(path: str) -> Column:
        return F.get_json_object(raw, path).try_cast("bigint")

    parts = F.coalesce(num("$.usageMetadata.promptTokenCount"), num("$.usage_metadata.promptTokenCount"), F.lit(0)) + F.coalesce(
        num("$.usageMetadata.candidatesTokenCount"), num("$.usage_metadata.candidatesTokenCount"), F.lit(0))
    has_meta = F.coalesce(F.get_json_object(raw, "$.usageMetadata"), F.get_json_object(raw, "$.usage_metadata")).isNotNull()
    return F.coalesce(
        num("$.usageMetadata.totalTokenCount"), num("$.usage_metadata.totalTokenCount"),
        num("$.usageMetadata.total_token_count"), num("$.usage_metadata.total_token_count"),
        F.when(has_meta, parts), num("$.usage.total_tokens"), F.lit(0),
    )


def usage_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id").agg(
        F.sum("tokens").alias("tokens"), F.count_if(F.col("kind") == "chat").alias("chat_calls"),
        F.count_if(F.col("kind") == "generate").alias("generate_calls"))


def document_phase(has_type: Column, has_results: Column, full_quality: Column, has_fields: Column) -> Column:
    return F.when(~has_type, "SCAN").when(has_results | (full_quality & has_fields), "VALIDATE").otherwise("EXTRACT")


def next_required_step(has_type, compressed, has_inventory, has_results, full_quality, visual_pending, dpi: int = 150) -> Column:
    """The pipeline stage a document needs next ('' when none)."""
    return (
        F.when(~has_type & ~compressed, "compress_pages(dpi=48, quality=30)")
        .when(~has_type & ~has_inventory, "inventory_pages()")
        .when(~has_type, "classify_document_type()")
        .when(~has_results & ~full_quality, f"convert_pdf_to_images(dpi={dpi})")
        .when(visual_pending, "check_compliance_visual(page_num=N) — visual checks are pending")
        .otherwise("")
    )


def phase_changes(log: DataFrame) -> DataFrame:
    """Turns whose phase differs from the turn before (the first one counts)."""
    rows = running(log, ["run_id"], "seq", [Prefix("_before", "last", F.col("phase"), inclusive=False)])
    return rows.filter(~F.col("phase").eqNullSafe(F.col("_before"))).drop("_before")


def step_durations(log: DataFrame) -> DataFrame:
    """Elapsed and running total per event."""
    return running(log, ["run_id"], "seq", [Prefix("total_ms", "sum", F.col("elapsed_ms"))])


def result_summary(log: DataFrame) -> DataFrame:
    """Outcome counts per tool from result JSON."""
    r = F.col("result")

    def size(path: str) -> Column:
        return F.coalesce(F.json_array_length(F.get_json_object(r, path)), F.get_json_object(r, path).try_cast("int"), F.lit(0))

    success = F.coalesce(F.get_json_object(r, "$.success"), F.lit("true")) != "false"
    return log.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(~success).alias("failed_calls"),
        F.sum(size("$.merge_result.updated")).alias("fields_merged"), F.sum(size("$.merge_result.null_fields")).alias("null_fields"),
        F.sum(size("$.merge_result.already_have_better")).alias("kept_fields"), F.sum(size("$.page_count")).alias("pages"),
        F.sum(size("$.passed")).alias("rules_passed"), F.sum(size("$.failed_errors")).alias("rule_errors"),
    )


def scan_run_log(spark, path: str, streaming: bool = False) -> DataFrame:
    """JSON-lines run log with its declared schema."""
    schema = "run_id string, turn int, ts timestamp, tool string, params string, reasoning string, result string, elapsed_ms bigint"
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)
