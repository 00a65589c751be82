"""Finding field values in OCR lines with coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import squeeze
from ..functions.text import fold_any_script
from .scale import grown, join_inside

# Label coverage, reading thresholds, paddings, reach below a label.
MIN_TERM_CHARS = 3
MIN_COVERAGE = 0.15
DIRECT_FROM = 0.80
REACH_HEIGHTS = 2.5
MIN_OVERLAP = 0.2
UNION_PADDING = 0.02


def search_terms(fields: DataFrame) -> DataFrame:
    """Folded labels and aliases per (type, field), long enough to mean something."""
    words = F.array_union(F.array("field_label"), F.coalesce("aliases", F.array().cast("array<string>")))
    terms = fields.select("invoice_type_id", "field_name", F.explode(words).alias("_w"))
    return terms.filter(F.length(F.trim("_w")) >= MIN_TERM_CHARS).select(
        "invoice_type_id", "field_name", fold_any_script(F.col("_w")).alias("term")
    )


def localize_labels(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """Best label line per (document, page, field).

    Terms are configuration, so every line meets only the terms of its type; the
    best line is a map-side combinable maximum.
    """
    folded = lines.filter(F.trim("text") != "").withColumn("_norm", fold_any_script(F.col("text")))
    hits = folded.join(search_terms(fields), "invoice_type_id").filter(F.col("_norm").contains(F.col("term")))
    score = F.length("term") / F.greatest(F.length("_norm"), F.lit(1))
    line = F.struct("line_no", "text", "confidence", "x1", "y1", "x2", "y2", "image_width", "image_height")
    best = hits.withColumn("_score", score).groupBy("doc_id", "page_num", "field_name").agg(
        F.max_by(line, F.struct("_score", -F.col("line_no"))).alias("_l"), F.max("_score").alias("score")
    )
    return best.filter(F.col("score") >= MIN_COVERAGE).select("doc_id", "page_num", "field_name", "score", "_l.*")


def _height() -> Column:
    return F.greatest(F.col("y2") - F.col("y1"), F.lit(1))


def value_below(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Nearest line below each label with enough horizontal overlap.

    Labels meet the lines of their page, which holds a bounded number of both; the nearest is found where they met.
    """
    wanted = labels.select("doc_id", "page_num", "field_name", F.col("x1").alias("_x1"), F.col("x2").alias("_x2"),
                           F.col("y2").alias("_y2"), (F.col("y2") + _height() * REACH_HEIGHTS).alias("_reach"))
    offered = lines.select("doc_id", "page_num", F.struct("y1", "line_no", "text", "confidence", "x1", "x2", "y2").alias("_v"))
    overlap = F.least("_v.x2", "_x2") - F.greatest("_v.x1", "_x1")
    near = wanted.join(grown(offered), ["doc_id", "page_num"]).filter(
        (F.col("_v.y1") > F.col("_y2")) & (F.col("_v.y1") <= F.col("_reach"))
        & (overlap >= (F.col("_x2") - F.col("_x1")) * MIN_OVERLAP)
    )
    return near.groupBy("doc_id", "page_num", "field_name").agg(F.min("_v").alias("below"))


def localize_values(lines: DataFrame, fields: DataFrame) -> DataFrame:
    """Value text, confidence and crop box per field: inline, below, or blank area."""
    labels = localize_labels(lines, fields)
    rows = join_inside(labels, value_below(labels, lines), ["doc_id", "page_num"], ["field_name"])
    pad_x = F.greatest(F.lit(8), F.floor(F.col("image_width") * 0.015))
    pad_y = F.greatest(F.lit(4), F.floor(F.col("image_height") * 0.008))
    after = squeeze(F.regexp_extract("text", r"(?s)^[^:]*:(.*)$", 1))
    inline = F.col("text").contains(":") & (after != "")
    below = F.col("below").isNotNull()
    said = F.trim(F.col("below.text")) != ""
    width, height = F.col("x2") - F.col("x1"), _height()

    def pick(a, b, c) -> Column:
        return F.when(inline, a).when(below, b).otherwise(c)

    left = pick(F.col("x1"), F.least("x1", "below.x1"), F.col("x1"))
    right = pick(F.col("x2"), F.greatest("x2", "below.x2"), F.col("x2") + F.floor(width * 1.5))
    bottom = pick(F.col("y2"), F.col("below.y2"), F.col("y2") + height * 3)
    return rows.select(
        "doc_id", "page_num", "field_name", "line_no",
        pick(after, F.when(said, F.col("below.text")), F.lit(None).cast("string")).alias("value_text"),
        pick(F.col("confidence"), F.when(said, F.col("below.confidence")).otherwise(0.0), F.lit(0.0)).alias("value_confidence"),
        F.greatest(F.lit(0), left - pad_x).cast("int").alias("x1"),
        F.greatest(F.lit(0), F.col("y1") - pad_y).cast("int").alias("y1"),
        F.least(F.col("image_width"), right + pad_x).cast("int").alias("x2"),
        F.least(F.col("image_height"), bottom + pad_y).cast("int").alias("y2"),
        "image_width", "image_height",
    )


def route_extraction(found: Column, value_text: Column, value_confidence: Column) -> Column:
    """ocr_direct, ocr_crop or fallback for one field of a page."""
    direct = (value_confidence >= DIRECT_FROM) & (F.coalesce(value_text, F.lit("")) != "")
    return F.when(~F.coalesce(found, F.lit(False)), "fallback").when(direct, "ocr_direct").otherwise("ocr_crop")


def union_boxes(boxes: DataFrame, keys=("doc_id", "page_num", "region")) -> DataFrame:
    """Envelope of boxes per region with proportional padding, inside the image."""
    env = boxes.groupBy(*keys).agg(
        F.min("x1").alias("_x1"), F.min("y1").alias("_y1"), F.max("x2").alias("_x2"), F.max("y2").alias("_y2"),
        F.max("image_width").alias("_w"), F.max("image_height").alias("_h"),
    )
    px, py = F.floor(F.col("_w") * UNION_PADDING), F.floor(F.col("_h") * UNION_PADDING)
    return env.select(
        *keys, F.greatest(F.lit(0), F.col("_x1") - px).cast("int").alias("x1"),
        F.greatest(F.lit(0), F.col("_y1") - py).cast("int").alias("y1"),
        F.least(F.col("_w"), F.col("_x2") + px).cast("int").alias("x2"),
        F.least(F.col("_h"), F.col("_y2") + py).cast("int").alias("y2"),
    )


def lines_in_crop(crops: DataFrame, lines: DataFrame, key: str = "region") -> DataFrame:
    """Lines intersecting each crop box, joined page by page; a page holds a bounded number of both."""
    boxes = crops.select("doc_id", "page_num", key, *[F.col(c).alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")])
    rows = lines.select("doc_id", "page_num", "line_no", "text", "x1", "y1", "x2", "y2")
    meet = rows.join(grown(boxes), ["doc_id", "page_num"]).filter(
        (F.col("x1") < F.col("_x2")) & (F.col("x2") > F.col("_x1")) & (F.col("y1") < F.col("_y2")) & (F.col("y2") > F.col("_y1"))
    )
    return meet.select("doc_id", "page_num", key, "line_no", "text")


def full_text(lines: DataFrame, keys=("doc_id", "page_num")) -> DataFrame:
    """Text of a page, one row each: its lines in order, blank ones left out."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.filter(F.trim("text") != "").groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["text"]), "\n").alias("full_text")
    )
