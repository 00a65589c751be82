"""Learnings store: parsing, reading and changing versioned notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import squeeze
from .scale import Prefix, running

# Fixed patterns of the notes format.
BULLET = r"^- \[L(\d+)\] \[(\d{4}-\d{2}-\d{2})\] (.*)$"
EDITED = r"^(.*) \[edited (\d{4}-\d{2}-\d{2})\]$"
VISION_CATEGORY = "vision_model_extraction"


def parse_learnings(files: DataFrame, key: str = "file_id") -> DataFrame:
    """Markdown text to rows: type headings, category headings, bullet lines.

    Pure generators inside each row: no shuffle and no carry-forward state.
    """
    def cut(df: DataFrame, column: str, pattern: str, pos: str, name: str, rest: str, keep: list[str]) -> DataFrame:
        parts = df.select(*keep, F.posexplode(F.split(column, pattern)).alias(pos, "_part")).filter(F.col(pos) > 0)
        head = squeeze(F.regexp_extract("_part", r"^([^\n]*)", 1))
        return parts.select(*keep, pos, head.alias(name), F.regexp_extract("_part", r"(?s)^[^\n]*\n(.*)$", 1).alias(rest))

    types = cut(files, "text", r"(?m)^## ", "_t", "invoice_type_id", "_body", [key])
    cats = cut(types, "_body", r"(?m)^### ", "_c", "category", "_lines", [key, "_t", "invoice_type_id"])
    lines = cats.select(key, "_t", "_c", "invoice_type_id", "category", F.posexplode(F.split("_lines", "\n")).alias("_l", "line"))
    bullets = lines.filter(F.col("line").startswith("-"))
    body = F.coalesce(F.nullif(F.regexp_extract("line", BULLET, 3), F.lit("")), squeeze(F.substring("line", 2, 1_000_000_000)))
    edited = F.nullif(F.regexp_extract(body, EDITED, 2), F.lit(""))
    return bullets.select(
        key, F.nullif(F.regexp_extract("line", BULLET, 1), F.lit("")).cast("int").alias("learning_id"),
        "invoice_type_id", "category", F.nullif(F.regexp_extract("line", BULLET, 2), F.lit("")).alias("entry_date"),
        edited.alias("edited_date"), F.when(edited.isNotNull(), F.regexp_extract(body, EDITED, 1)).otherwise(body).alias("content"),
    )


def read_learnings(learnings: DataFrame, invoice_type_id: str) -> DataFrame:
    return learnings.filter(F.col("invoice_type_id").isin("GENERAL", invoice_type_id))


def format_id(number: Column) -> Column:
    text = number.cast("string")
    return F.concat(F.lit("L"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def normalize_id(raw: Column) -> Column:
    bare = F.upper(F.regexp_replace(raw, r"^[\[\]]+|[\[\]]+$", ""))
    return F.when(bare.startswith("L"), bare).otherwise(F.concat(F.lit("L"), bare))


def _width(text: Column) -> Column:
    """Block width for a content length: two blocks always fit inside it."""
    n = F.length(text)
    return F.when(n >= 31, 16).when(n >= 7, 4).otherwise(1)


def contained_in(new: DataFrame, existing: DataFrame, new_id: str = "new_id", earlier: str | None = None) -> DataFrame:
    """Ids of new texts that occur inside some existing text (both lower-cased).

    Existing texts are cut into blocks at fixed positions.  Whatever the
    alignment, a contained text of sufficient length covers whole blocks, so for
    each of its few alignments the rarest of those blocks is looked up and only
    those candidates are compared.  An alignment with an unseen block is
    impossible and drops out.  With ``earlier``, a column of the existing texts,
    only those count whose value lies below the new text's id.  Blocks and texts
    travel as 64-bit hashes: equal ones meet, others may, and the candidates are
    compared as texts, each text once.
    """
    since = F.min(earlier) if earlier else F.lit(None).cast("bigint")
    texts = existing.select(F.lower("content").alias("_t"), *([earlier] if earlier else [])).withColumn("_id", F.xxhash64("_t"))

    def hashed(width: int) -> Column:
        return F.transform(F.regexp_extract_all("_t", F.lit(f"(?s).{{{width}}}"), F.lit(0)), lambda b: F.xxhash64(F.lit(width), b))

    cut = texts.select("_id", F.explode(F.array_distinct(F.flatten(F.array(*[hashed(w) for w in (16, 4, 1)])))).alias("_b"))
    wanted = new.select(F.col(new_id), F.lower(squeeze(F.col("content"))).alias("_n")).filter("_n <> ''").withColumn("_w", _width(F.col("_n")))
    aligned = wanted.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
    blocks = aligned.select(new_id, "_n", "_w", "_o", F.explode(F.transform(
        F.sequence(F.lit(0), F.floor((F.length("_n") - F.col("_o")) / F.col("_w")).cast("int") - 1),
        lambda i: F.xxhash64(F.col("_w"), F.substr(F.col("_n"), F.col("_o") + i * F.col("_w") + 1, F.col("_w"))))).alias("_b"))
    used = blocks.select("_b").distinct()
    seen = cut.join(used, "_b", "left_semi").distinct()
    sizes = seen.groupBy("_b").agg(F.count(F.lit(1)).alias("_df"))
    rated = blocks.join(sizes, "_b", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    rarest = rated.groupBy(new_id, "_n", "_o").agg(F.min(F.struct("_df", "_b")).alias("_r")).filter("_r._df > 0")
    probes = rarest.select(new_id, "_n", F.col("_r._b").alias("_b")).distinct()
    candidates = probes.join(seen, "_b").select(new_id, "_n", "_id").distinct()
    said = texts.groupBy("_id", "_t").agg(since.alias("_since"))
    hits = candidates.join(said, "_id").filter(F.col("_t").contains(F.col("_n")))
    if earlier:
        hits = hits.filter(F.col("_since") < F.col(new_id))
    return hits.select(new_id).distinct()


def insert_learnings(learnings: DataFrame, new: DataFrame, entry_date: str, new_id: str = "new_id") -> DataFrame:
    """New notes with ids after the largest one; content that is already said is skipped.

    ``new`` carries an integer ``new_id`` giving the order of insertion.  A note
    is skipped if an existing note or an earlier one of ``new`` contains it.  What
    contains a skipped note's text contains all of it, so skipped ones may count.
    """
    new = new.withColumn("content", squeeze(F.col("content")))
    fresh = new.join(contained_in(new, learnings, new_id), new_id, "left_anti").filter(F.col("content") != "")
    fresh = fresh.join(contained_in(fresh, fresh, new_id, earlier=new_id), new_id, "left_anti")
    top = learnings.agg(F.coalesce(F.max("learning_id"), F.lit(0))).scalar()
    rows = running(fresh, [], new_id, [Prefix("_rank", "sum", F.lit(1))])
    return rows.select(
        (top + F.col("_rank")).cast("int").alias("learning_id"), "invoice_type_id", "category",
        F.lit(entry_date).alias("entry_date"), F.lit(None).cast("string").alias("edited_date"), "content",
    )


def edit_learnings(learnings: DataFrame, edits: DataFrame, edited_date: str) -> DataFrame:
    """Replace contents by id; the entry date stays, the edit date is stamped."""
    wanted = edits.select(normalize_id(F.col("learning_id")).alias("_id"), squeeze(F.col("content")).alias("_new"))
    rows = learnings.withColumn("_id", format_id(F.col("learning_id"))).join(wanted, "_id", "left")
    touched = F.col("_new").isNotNull()
    return rows.withColumns(
        {"content": F.coalesce("_new", "content"), "edited_date": F.when(touched, edited_date).otherwise(F.col("edited_date"))}
    ).drop("_id", "_new")


def delete_learnings(learnings: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(normalize_id(F.col("learning_id")).alias("_id"))
    return learnings.withColumn("_id", format_id(F.col("learning_id"))).join(gone, "_id", "left_anti").drop("_id")


def reset_learnings(learnings: DataFrame, invoice_type_id: str = "", category: str = "") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): everything, one type, or one category of a type."""
    if not invoice_type_id:
        hit = F.lit(True)
    elif not category:
        hit = F.col("invoice_type_id") == invoice_type_id
    else:
        hit = (F.col("invoice_type_id") == invoice_type_id) & (F.col("category") == category)
    return learnings.filter(~hit), learnings.filter(hit)


def first_occurrence(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values up to case, keeping the earliest; order values are unique."""
    folded = F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))  # full case folding of the sharp s
    first = rows.groupBy(folded.alias("_k")).agg(F.min(order).alias("_o"))
    return rows.join(first.select(F.col("_o").alias(order)), order, "left_semi")


def vision_hints(learnings: DataFrame, order: str = "learning_id") -> DataFrame:
    """Distinct hints of the vision category without their prefixes."""
    rows = learnings.filter(F.lower("category") == VISION_CATEGORY)
    bare = F.regexp_replace("content", r"(?i)^\[L\d+\]\s*(\[\d{4}-\d{2}-\d{2}\]\s*)?", "")
    bare = squeeze(F.regexp_replace(bare, r"(?i)^\[initial\]\s*", ""))
    return first_occurrence(rows.withColumn("hint", bare).filter("hint <> ''"), "hint", order)


def carry_heading(lines: DataFrame, keys: list[str], order: str, heading: Column) -> DataFrame:
    """Each line with the latest heading at or before it."""
    return running(lines, keys, order, [Prefix("heading", "last", heading)])


