"""Field-extraction attempts resolved to one value per (document, field)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blanks import is_blank, squeeze
from ..functions.dates import is_date_fragment
from ..functions.numbers import clamp_unit, rule_number
from ..functions.text import clean_updates, role_like, sanitize_text, snap_enum
from .merge_state import attempt_summaries, resolved
from .scale import CHUNK_ROWS, join_inside

# Review thresholds, backfill confidence.
ATTENTION_BELOW = 0.65
DONE_FROM = 0.85
BACKFILL_CONFIDENCE = 0.86


def coerce_attempts(attempts: DataFrame, fields: DataFrame) -> DataFrame:
    """Type-aware cleaning of raw attempt values against the field schema.

    Decimals become plain numbers where readable, strings and dates lose markup,
    and enumerated fields snap to an allowed value or become null.
    """
    schema = fields.select("invoice_type_id", "field_name", "field_id", "data_type", "allowed_values")
    joined = attempts.join(F.broadcast(schema), ["invoice_type_id", "field_name"])
    raw = F.col("value_text")
    # Each reading is a column before others mention it: Catalyst copies an expression into every mention.
    is_decimal = F.lower(F.trim("data_type")) == "decimal"
    read = joined.withColumn("_decimal", is_decimal).withColumns({
        "_number": F.when(F.coalesce("_decimal", F.lit(True)), rule_number(raw)), "_text": F.when(F.col("_decimal"), raw).otherwise(sanitize_text(raw))})
    listed = (F.size("allowed_values") > 0) & ~(F.col("_decimal") & F.col("_number").isNotNull())
    return read.withColumns(
        {
            "value_num": F.when(F.col("_decimal"), F.col("_number")),
            "value_text": F.when(listed, snap_enum(F.col("_text"), F.col("allowed_values"))).otherwise(F.col("_text")),
            "confidence": clamp_unit(F.col("confidence")),
        }
    ).drop("data_type", "allowed_values", "_decimal", "_number", "_text")


def merge_extractions(
    attempts: DataFrame,
    keys: Sequence[str] = ("doc_id", "field_name"),
    order: str = "seq",
    payload: Sequence[str] = ("value_text",),
    ignore_nulls: bool = False,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Resolve ordered attempts to one value per key.

    See ``merge_state``: a chunk covers ``chunk_rows`` numbers of ``order``, chunks are summarised by
    themselves and their summaries composed. ``ignore_nulls`` leaves null attempts out altogether.
    """
    rows = attempts.filter(F.col(payload[0]).isNotNull()) if ignore_nulls else attempts
    held = resolved(attempt_summaries(rows, keys, order, payload, chunk_rows))
    return held.withColumn("batch_review", F.col("has_value") & in_batch_band(F.col("confidence"))).drop("has_value")


def field_retry_counts(attempts: DataFrame) -> DataFrame:
    """How often each field of each document was tried."""
    return attempts.groupBy("doc_id", "field_name").agg(F.count(F.lit(1)).alias("retry_count"))


def in_batch_band(confidence: Column) -> Column:
    return (confidence >= ATTENTION_BELOW) & (confidence < DONE_FROM)


def confidence_band(value: Column, confidence: Column, flagged: Column) -> Column:
    """attention / batch_review / done for one field result."""
    return (
        F.when(F.coalesce(flagged, F.lit(False)) | value.isNull(), "attention")
        .when(in_batch_band(confidence), "batch_review")
        .when(confidence >= ATTENTION_BELOW, "done")
        .otherwise("attention")
    )


def flag_for_review(field_results: DataFrame, flags: DataFrame) -> DataFrame:
    """Apply review flags; a flag for an absent field adds a placeholder row."""
    wanted = flags.groupBy("doc_id", "field_name").agg(F.max("reason").alias("_reason"))
    joined = field_results.withColumn("_known", F.lit(True)).join(wanted, ["doc_id", "field_name"], "full_outer")
    asked = F.col("_reason").isNotNull()
    new = F.col("_known").isNull()
    return joined.withColumns(
        {
            "field_id": F.when(new, F.col("field_name")).otherwise(F.col("field_id")),
            "confidence": F.when(new, F.lit(0.0)).otherwise(F.col("confidence")),
            "flagged_for_review": asked | F.coalesce("flagged_for_review", F.lit(False)),
            "review_reason": F.coalesce("_reason", "review_reason"),
        }
    ).drop("_reason", "_known")


def backfill_fields(
    field_results: DataFrame, verdicts: DataFrame, fields: DataFrame, denylist: Sequence[str] = (), more: Sequence[str] = ()
) -> DataFrame:
    """Fill empty fields from the updates of passed visual verdicts.

    ``verdicts`` carries doc_id, invoice_type_id, rule_id, rule_order, page_num,
    passes and field_updates.  The first usable update in rule order wins.  A row made of an
    update alone takes the columns ``more``, which both sides have, from its verdict.
    """
    offers = (
        verdicts.filter("passes")
        .select("doc_id", "invoice_type_id", "rule_id", "rule_order", "page_num", *more,
                F.explode(clean_updates(F.col("field_updates"))).alias("field_name", "_raw"))
        .join(fields.select("invoice_type_id", "field_name", F.col("field_id").alias("_fid")),
              ["invoice_type_id", "field_name"])
        .withColumn("_offer", squeeze(sanitize_text(F.col("_raw"))))
        .filter(F.col("_offer") != "")
        .filter((F.col("field_name") != "employee_name") | ~role_like(F.col("_offer"), denylist))
        .filter((F.col("field_name") != "payment_method") | ~is_date_fragment(F.col("_offer")))
        .groupBy("doc_id", "field_name")
        .agg(F.min(F.struct("rule_order", "rule_id", "page_num", "_offer", "_fid", *more)).alias("_o"))
    )
    # Fields may stay where their document put them.
    keys = ["doc_id", "field_name"]
    joined = join_inside(field_results, offers, "doc_id", ["field_name"], "full_outer").select(
        *keys, *[c for c in field_results.columns if c not in keys], "_o")
    empty = is_blank(F.col("value_text"))
    junk = (F.col("field_name") == "payment_method") & is_date_fragment(F.col("value_text"))
    take = F.col("_o").isNotNull() & (empty | F.coalesce(junk, F.lit(False)))

    def swap(column: str, new: Column) -> Column:
        return F.when(take, new).otherwise(F.col(column))

    return joined.withColumns(
        {
            "field_id": swap("field_id", F.col("_o._fid")),
            "value_text": swap("value_text", F.col("_o._offer")),
            "confidence": swap("confidence", F.lit(BACKFILL_CONFIDENCE)),
            "source_page": swap("source_page", F.col("_o.page_num")),
            "source_region": swap("source_region", F.concat(F.lit("visual_"), "_o.rule_id", F.lit("_field_updates"))),
            "extraction_attempts": swap("extraction_attempts", F.coalesce("extraction_attempts", F.lit(0))),
            "flagged_for_review": swap("flagged_for_review", F.lit(True)),
            "review_reason": swap(
                "review_reason",
                F.concat(F.lit("Suggested by visual compliance "), "_o.rule_id", F.lit(" (field_updates) — verify")),
            ),
            "backfilled": take,
            **{c: F.coalesce(c, F.col(f"_o.{c}")) for c in more},
        }
    ).drop("_o")


def unattempted_fields(documents: DataFrame, fields: DataFrame, attempts: DataFrame) -> DataFrame:
    """Schema fields a document has never been asked for."""
    wanted = documents.select("doc_id", "invoice_type_id").join(
        fields.select("invoice_type_id", "field_name"), "invoice_type_id"
    )
    return wanted.join(attempts.select("doc_id", "field_name"), ["doc_id", "field_name"], "left_anti")


def next_field_batch(requested: DataFrame, untried: DataFrame, per_call: int | None = None) -> DataFrame:
    """Fields of the next call: requested first, then untried ones by name.

    ``requested`` carries doc_id, field_name and the position ``pos`` in the
    request; with ``per_call`` only that many slots of a document are returned.
    """
    asked = requested.groupBy("doc_id", "field_name").agg(F.min("pos").alias("_pos"))
    asked = asked.withColumn("_rank", F.lit(0))
    free = untried.select("doc_id", "field_name", F.lit(0).alias("_pos"), F.lit(1).alias("_rank")).join(
        asked.select("doc_id", "field_name"), ["doc_id", "field_name"], "left_anti"
    )
    slots = Window.partitionBy("doc_id").orderBy("_rank", "_pos", "field_name")
    placed = asked.unionByName(free).withColumn("slot", F.row_number().over(slots))
    if per_call is not None:
        placed = placed.filter(F.col("slot") <= per_call)
    return placed.select("doc_id", "field_name", "slot", (F.col("_rank") == 1).alias("added"))
