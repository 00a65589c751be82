"""Lines that many documents share, kept in one document only: range-partitioned hashes, streamed.

A line's key is the line without outer white space and with A-Z in lower case. Only lines whose key has
at least ``MIN_CHARS`` code points travel, as a 128-bit hash with document and position. They are dealt
out by ranges of (hash, document from the largest down, position) together, so a line that a third of all
documents hold spreads over a third of the ranges. Each sorted range is a slice; streaming it, the
first occurrence of a key is in the largest document of the slice that holds it, and a change of document
is one document more. One row per key and slice carries both on: over a key's slices the first one names
the document that keeps the line, and a document on a border of two slices counts once.

What a document loses comes back as runs of dropped positions, the run form of its compressed keep
bitmap, never as text; ``kept_text`` applies the runs.

Defined results: null or empty text is one empty line; a document is a ``doc_id``, so rows that share one
count once and all keep what the largest document keeps; a null ``doc_id`` is one document, smaller than
all others; repeated rows have repeated results; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Code points of a key, and documents that must hold it.
MIN_CHARS, MIN_DOCS = 40, 5
#: Fixed value: white space at the ends of a line.
OUTER = " \t\n\x0b\x0c\r"
_SLICE_BITS = 33


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(OUTER)), string.ascii_uppercase, string.ascii_lowercase)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _documents(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def line_entries(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, text_hash, position) of every line with a key of ``min_chars`` or more."""
    lines = _documents(docs).select("doc_id", "text_hash", F.posexplode(_lines(F.col("text"))).alias("position", "line"))
    keys = lines.select("doc_id", "text_hash", "position", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(13), "key").alias("h2"), "doc_id", "text_hash", "position")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_hash, n_dropped, dropped_runs) of the documents that lose lines."""
    entries = materialize(line_entries(docs, min_chars), "line-entries")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last(), F.col("text_hash"), F.col("position")]
    dealt = entries.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("at"))
    dealt = materialize(dealt, "line-ranges").withColumn("slice", F.shiftrightunsigned("at", _SLICE_BITS))

    stream = Window.partitionBy("slice").orderBy("at")
    same = lambda move: (move("h1").over(stream).eqNullSafe(F.col("h1"))) & (move("h2").over(stream).eqNullSafe(F.col("h2")))
    flow = dealt.select("slice", "h1", "h2", "doc_id", same(F.lag).alias("goes_on"), same(F.lead).alias("has_more"),
                        F.lag("doc_id").over(stream).eqNullSafe(F.col("doc_id")).alias("same_doc"))
    parts = flow.groupBy("slice", "h1", "h2").agg(
        F.sum(F.when(F.col("goes_on") & F.col("same_doc"), 0).otherwise(1)).alias("docs"),
        F.max(F.when(~F.col("goes_on"), F.col("doc_id"))).alias("first_doc"), F.max(F.when(~F.col("has_more"), F.col("doc_id"))).alias("last_doc"))
    by_slice = Window.partitionBy("h1", "h2").orderBy("slice")
    whole = by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = F.lag("slice").over(by_slice).isNotNull() & F.lag("last_doc").over(by_slice).eqNullSafe(F.col("first_doc"))
    parts = parts.withColumn("own", F.col("docs") - met.cast("int"))
    shared = parts.select("slice", "h1", "h2", F.first("first_doc").over(whole).alias("keeper"), F.sum("own").over(whole).alias("total"))
    shared = materialize(shared.where(F.col("total") >= min_docs), "shared-lines")

    lost = dealt.join(shared, ["slice", "h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("position")).alias("at"))
    starts = F.filter(F.transform("at", lambda x, i: F.when((i > 0) & (F.get("at", i - 1) == x - 1), None).otherwise(x)), lambda x: x.isNotNull())
    ends = F.filter(F.transform("at", lambda x, i: F.when(F.coalesce(F.get("at", i + 1) == x + 1, F.lit(False)), None).otherwise(x)), lambda x: x.isNotNull())
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    return materialize(lost.select("doc_id", "text_hash", F.size("at").cast("long").alias("n_dropped"), runs.alias("dropped_runs")), "keep-bitmaps")


def kept_text(text: Column, runs: Column) -> Column:
    """The text without the dropped runs (null: none)."""
    lines = _lines(text)
    to_end = F.concat(runs, F.array(F.struct(F.size(lines).alias("start"), F.lit(0).alias("length"))))

    def between(run: Column, i: Column) -> Column:
        begin = F.when(i > 0, F.get(runs, i - 1)["start"] + F.get(runs, i - 1)["length"]).otherwise(0)
        return F.slice(lines, begin + 1, run["start"] - begin)

    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(F.transform(to_end, between)), "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, dropped_runs) of every document; ``kept_text`` gives what stays."""
    rows, marks = _documents(docs).alias("d"), keep_bitmaps(docs, min_chars, min_docs).alias("m")
    met = rows.join(marks, F.expr("d.doc_id <=> m.doc_id and d.text_hash <=> m.text_hash"), "left")
    return met.select("d.doc_id", "d.text", F.size(_lines(F.col("d.text"))).cast("long").alias("n_lines"),
                      F.coalesce("m.n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "m.dropped_runs")
