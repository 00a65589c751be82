"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Every document gets a hash-random key. Its high bits are its bucket: buckets are equal ranges of the
key space, so (source, bucket) is a range partition of each source whose parts are of equal size, also
for a source that holds most rows. Sizes are summed per bucket first; prefix sums over that small table
give each bucket's offset and a window inside the bucket finishes the prefix sum of each document. A
source whose target exceeds its size repeats whole epochs; the last epoch is cut at the exact budget,
so the document on the border is taken in part.

Targets: sources ordered by code point, null last, weigh ``WEIGHTS`` in turn and share ``share`` of all
words; a target stops at ``cap`` times its source's words and the excess is shared again by weight.

Defined results: null or empty text has size 0 and nothing is taken; null sources are one source, apart
from the empty name; equal rows are interchangeable; further columns may have any name and kind; an empty table gives an empty result. Only one
window has no partition key: the one over the sources themselves, one row each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ordered_by, row_key, unpacked, whole_row, words_of

WEIGHTS = (3, 1, 2)
#: Documents of one bucket, about; the number of buckets follows the table.
BUCKET_ROWS = 20_000


def source_targets(sizes: DataFrame, share_percent: int = 150, cap: int = 2) -> DataFrame:
    """Target per source from (source, source_size): water-filling in closed form.

    Sources in the order of cap/weight: those that reach their cap are a prefix, since what is left per
    weight only falls once a source stays below its cap.
    """
    common = math.lcm(*WEIGHTS)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    s = sizes.select("source", "source_size", rank.alias("rank"), weight.alias("weight"), (F.col("source_size") * cap).alias("cap"))
    ratio = F.expr(f"cap * ({common} div weight)")
    before = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(ratio, "rank").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # all amounts times 100, so that the comparison is exact
    left = F.sum("source_size").over(whole) * share_percent - 100 * F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long"))
    s = s.withColumn("full", F.col("cap") * 100 * F.sum("weight").over(onward) <= F.col("weight") * left)
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)
    share = F.col("weight") * (F.sum("source_size").over(whole) * share_percent - 100 * spent)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share.cast("double") / (100 * open_weight).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, carry: list[str] | None = None, share_percent: int = 150, cap: int = 2) -> DataFrame:
    """Columns ``carry`` of every document with size, source_size, target and taken (words, repeats counted)."""
    carry = carry if carry is not None else ["doc_id"]
    sized = materialize(docs.select(
        F.struct(*carry).alias("row"), F.col("source").cast("string").alias("source"), F.size(words_of(F.col("text"))).cast("long").alias("size"),
        row_key(F.col("doc_id"), F.col("text").cast("string")).alias("key")), "mix-sized")
    bits = max(7, math.ceil(math.log2(max(1, sized.count()) / BUCKET_ROWS)))
    sized = sized.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits).cast("int"))
    parts = sized.groupBy("source", "bucket").agg(F.sum("size").alias("part_size"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), share_percent, cap)
    offset = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    parts = parts.withColumn("offset", offset).alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select(
        F.col("p.source").alias("p_source"), F.col("p.bucket").alias("p_bucket"), "p.offset", "t.source_size", "t.target")
    joined = sized.join(parts, F.expr("source <=> p_source and bucket = p_bucket"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", ordered_by(sized, "row")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - epochs * F.col("source_size") - before))
    return joined.withColumn("taken", (epochs * F.col("size") + last).cast("long")).select(
        *[F.col("row")[c].alias(c) for c in carry], "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each epoch a document takes part in, the last one cut to its words.

    A cut text is its first words, joined by spaces; ``n_chars`` follows. Columns are those of ``docs``.
    """
    kept = whole_row(docs).alias("__doc")
    rows = mix(docs.select("doc_id", "text", "source", kept), ["__doc"]).where("taken > 0")
    rows = rows.withColumn("part", F.explode(F.expr(
        "concat(array_repeat(size, cast(taken div size as int)), if(taken % size > 0, array(taken % size), array()))")))
    cut = F.col("part") < F.col("size")
    text = F.when(cut, F.array_join(F.slice(words_of(F.col("__doc.text")), 1, F.col("part").cast("int")), " ")).otherwise(F.col("__doc.text"))
    out = rows.select("__doc", cut.alias("cut"), text.alias("text"))
    made = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("__doc")["n_chars"])}
    return unpacked(out, "__doc", docs, made)
