"""Row numbers in a global order or inside groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: ``monotonically_increasing_id`` keeps the row inside its partition in the low 33 bits.
_ROW_BITS = 33


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the 0-based number of each row in its group (``keys``, not null; none: the whole table).

    Rows are dealt out by ranges of keys and order together, so a group that holds a third of all rows
    spreads over a third of the partitions. Each sorted partition is a slice that numbers its own rows;
    one row per slice and group carries the numbers on from slice to slice. The sorted table is written
    first, so that the numbers don't depend on the run of a task. Rows equal in ``order`` may come in any order.
    """
    ranges = [F.col(k) for k in keys] + order
    dealt = df.repartitionByRange(*ranges).sortWithinPartitions(*ranges).select("*", F.monotonically_increasing_id().alias("__at"))
    dealt = materialize(dealt, "ordered").withColumn("__slice", F.shiftrightunsigned("__at", _ROW_BITS))
    slices = dealt.groupBy(*keys, "__slice").agg(F.count("*").alias("__rows"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, "__slice", (F.coalesce(F.sum("__rows").over(before), F.lit(0).cast("long")) - F.col("__first")).alias("__shift"))
    return dealt.join(slices, [*keys, "__slice"]).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name))
