"""Learnings-store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learnings as N
from ..operators.scale import Prefix, running
from . import scenario
from .registry import query


def markdown(spark, sf_dir):
    """Each document as a notes file: headings every ninth line, bullets between."""
    def line(text, i):
        return (F.when(i % 9 == 0, F.concat(F.lit("## TYPE"), i % 4)).when(i % 9 == 1, F.concat(F.lit("### cat"), i % 5))
                .when(i % 9 == 2, F.concat(F.lit("- plain "), text)).when(i % 9 == 3, F.concat(F.lit("note "), text))
                .when(i % 9 == 4, F.concat(F.lit("- [L"), F.lpad(i.cast("string"), 3, "0"), F.lit("] [2024-01-02] "), text, F.lit(" [edited 2024-02-03]")))
                .otherwise(F.concat(F.lit("- [L"), F.lpad(i.cast("string"), 3, "0"), F.lit("] [2024-01-02] "), text)))

    docs = scenario.read(spark, sf_dir, "documents")
    lines = F.transform(F.split(F.regexp_replace("text", r"[^\S\n]+", " "), "\n"), lambda t, i: line(F.trim(t), i))
    return docs.select(F.col("doc_id").alias("file_id"), F.array_join(lines, "\n").alias("text"))


@query("parse_learnings")
def parse_learnings(spark, sf_dir):
    return N.parse_learnings(markdown(spark, sf_dir)).withColumn("content", F.md5("content"))


def store(spark, sf_dir):
    """Notes: benchmark texts under five scopes and six categories."""
    b = scenario.read(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    scopes = F.array(F.lit("GENERAL"), *[F.lit(t[1]) for t in scenario.TYPES[:4]])
    cats = F.array(*[F.lit(c) for c in ("approaches", "vision_model_extraction", "common_failures")])
    return b.select((k + 1).cast("int").alias("learning_id"), F.element_at(scopes, (1 + k % 5).cast("int")).alias("invoice_type_id"),
                    F.element_at(cats, (1 + k % 3).cast("int")).alias("category"), F.lit("2024-01-01").alias("entry_date"),
                    F.lit(None).cast("string").alias("edited_date"), F.col("text").alias("content"))


@query("read_learnings")
def read_learnings(spark, sf_dir):
    return N.read_learnings(store(spark, sf_dir), "VIAJES").select("learning_id", "invoice_type_id", "category")


def document_notes(spark, sf_dir):
    d = scenario.read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("learning_id"), "text").withColumnRenamed("text", "content")


def new_notes(spark, sf_dir):
    """Sentences of the benchmark texts as new notes."""
    b = scenario.read(spark, sf_dir, "benchmark")
    cut = b.select("item_id", F.posexplode(F.split("text", r"[.\n]+ *")).alias("pos", "content"))
    return cut.select((F.col("item_id") * 1000 + F.col("pos")).alias("new_id"), F.lit("GENERAL").alias("invoice_type_id"),
                      F.lit("approaches").alias("category"), "content")


@query("contained_learnings")
def contained_learnings(spark, sf_dir):
    """New notes already said somewhere in the whole document texts."""
    return N.contained_in(new_notes(spark, sf_dir), document_notes(spark, sf_dir))


@query("insert_learnings")
def insert_learnings(spark, sf_dir):
    added = N.insert_learnings(document_notes(spark, sf_dir).withColumn("learning_id", F.col("learning_id").cast("int")), new_notes(spark, sf_dir), "2024-05-05")
    return added.select("learning_id", N.format_id(F.col("learning_id")).alias("label"), "entry_date", F.md5("content").alias("digest"))


@query("edit_learnings")
def edit_learnings(spark, sf_dir):
    k = F.col("item_id")
    edits = scenario.read(spark, sf_dir, "benchmark").filter("item_id % 4 = 1").select(
        F.when(k % 8 == 1, F.concat(F.lit("[l"), F.lpad(k.cast("string"), 3, "0"), F.lit("]"))).otherwise(F.lpad(k.cast("string"), 3, "0")).alias("learning_id"),
        F.concat(F.lit(" new "), k).alias("content"))
    return N.edit_learnings(store(spark, sf_dir), edits, "2024-06-06").select("learning_id", "entry_date", "edited_date", F.md5("content").alias("digest"))


@query("delete_learnings")
def delete_learnings(spark, sf_dir):
    ids = scenario.read(spark, sf_dir, "benchmark").filter("item_id % 3 = 0").select(N.format_id(F.col("item_id")).alias("learning_id"))
    return N.delete_learnings(store(spark, sf_dir), ids).select("learning_id")


@query("reset_learnings")
def reset_learnings(spark, sf_dir):
    kept, removed = N.reset_learnings(store(spark, sf_dir), "VIAJES", "approaches")
    return kept.select("learning_id", F.lit("kept").alias("side")).unionByName(removed.select("learning_id", F.lit("removed").alias("side")))


@query("vision_hints")
def vision_hints(spark, sf_dir):
    rows = store(spark, sf_dir)
    twice = rows.unionByName(rows.withColumns({"learning_id": F.col("learning_id") + 100000, "content": F.concat(F.lit("[L123] [2024-01-01] [Initial] "), F.upper("content"))}))
    return N.vision_hints(twice).select("learning_id", F.md5("hint").alias("digest"))


@query("first_occurrence")
def first_occurrence(spark, sf_dir):
    e = scenario.read(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit(":"), "user_id").alias("what"))
    return N.first_occurrence(e, "what", "event_id")


@query("carry_heading")
def carry_heading(spark, sf_dir):
    """Section carry-forward over document lines numbered across the table."""
    d = scenario.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    head = F.when(F.length("line") % 5 == 0, F.md5("line"))
    return N.carry_heading(d, ["doc_id"], "line_no", head).select("doc_id", "line_no", "heading")


@query("next_learning_id")
def next_learning_id(spark, sf_dir):
    """Dense ids after the largest one, in event order, over the whole table."""
    e = scenario.read(spark, sf_dir, "events").select("event_id")
    rows = running(e, [], "event_id", [Prefix("rank", "sum", F.lit(1))], chunk_rows=512)
    return rows.select("event_id", N.format_id(F.lit(41) + F.col("rank")).alias("learning_id"))
