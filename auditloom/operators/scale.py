"""Building blocks that keep hot keys off a single task.

``running`` computes ordered prefix aggregates in two levels.  Rows are cut into
chunks of the order column; each chunk is aggregated on the map side, the small
chunk table carries prefixes from chunk to chunk, and the rows themselves are
only windowed inside their own chunk.  A run or document holding a third of all
rows is therefore spread over as many tasks as it has chunks.  Without keys the
chunk table itself is cut into spans in the same way, so the one window that has
no partition sees a row per ``CHUNK_SPAN`` chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536
CHUNK_SPAN = 4_096
SMALL_SIDE_ROWS = 50_000
TASK_ROWS = 16_384


@dataclass(frozen=True)
class Prefix:
    """One prefix aggregate: ``how`` is sum, min, max, xor or last (non-null)."""

    name: str
    how: str
    value: Column
    inclusive: bool = True


def _pick(how: str, left: Column, right: Column) -> Column:
    """Combine the carried prefix (left) with the chunk-local one (right)."""
    if how == "sum":
        return F.coalesce(left + right, left, right)
    if how == "xor":
        return F.coalesce(left.bitwiseXOR(right), left, right)
    if how == "last":
        return F.coalesce(right, left)
    return F.greatest(left, right) if how == "max" else F.least(left, right)


_WHOLE = {"sum": F.sum, "max": F.max, "min": F.min, "xor": F.bit_xor}


def _total(how: str, value: Column, order: str) -> Column:
    """A chunk's or span's own contribution."""
    return F.max_by(value, F.when(value.isNotNull(), F.col(order))) if how == "last" else _WHOLE[how](value)


def _over(how: str, value: Column, window) -> Column:
    return F.last(value, ignorenulls=True).over(window) if how == "last" else _WHOLE[how](value).over(window)


def _carried(chunks: DataFrame, keys: Sequence[str], hows: Sequence[str], span: int) -> DataFrame:
    """(keys, _chunk, _c0, ..): what lies before each chunk, from the chunk totals _t0, .."""
    ahead = (Window.unboundedPreceding, -1)
    if keys:
        before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*ahead)
        return chunks.select(*keys, "_chunk", *[_over(h, F.col(f"_t{i}"), before).alias(f"_c{i}") for i, h in enumerate(hows)])
    spans = chunks.withColumn("_span", F.expr(f"_chunk div {int(span)}"))
    tops = spans.groupBy("_span").agg(*[_total(h, F.col(f"_t{i}"), "_chunk").alias(f"_s{i}") for i, h in enumerate(hows)])
    first = Window.orderBy("_span").rowsBetween(*ahead)
    tops = tops.select("_span", *[_over(h, F.col(f"_s{i}"), first).alias(f"_u{i}") for i, h in enumerate(hows)])
    inside = Window.partitionBy("_span").orderBy("_chunk").rowsBetween(*ahead)
    return spans.join(tops, "_span").select(
        "_chunk", *[_pick(h, F.col(f"_u{i}"), _over(h, F.col(f"_t{i}"), inside)).alias(f"_c{i}") for i, h in enumerate(hows)])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    prefixes: Sequence[Prefix],
    chunk_rows: int = CHUNK_ROWS,
    chunk_span: int = CHUNK_SPAN,
) -> DataFrame:
    """Add prefix aggregates per key in the order of an integer column.

    ``order`` must be unique within the keys, and the keys must not be null.
    """
    keys = list(keys)
    staged = df.withColumn("_chunk", F.expr(f"`{order}` div {int(chunk_rows)}"))
    for i, p in enumerate(prefixes):
        staged = staged.withColumn(f"_v{i}", p.value)

    hows = [p.how for p in prefixes]
    chunks = staged.groupBy(*keys, "_chunk").agg(*[_total(h, F.col(f"_v{i}"), order).alias(f"_t{i}") for i, h in enumerate(hows)])
    carry = _carried(chunks, keys, hows, chunk_span)

    local = Window.partitionBy(*keys, "_chunk").orderBy(order)
    upto = {True: local.rowsBetween(Window.unboundedPreceding, 0),
            False: local.rowsBetween(Window.unboundedPreceding, -1)}
    out = staged.join(carry, [*keys, "_chunk"])
    results = []
    for i, p in enumerate(prefixes):
        results.append(_pick(p.how, F.col(f"_c{i}"), _over(p.how, F.col(f"_v{i}"), upto[p.inclusive])).alias(p.name))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *results)


def bounded_rows(df: DataFrame, max_rows: int = SMALL_SIDE_ROWS) -> list:
    """Rows of a configuration table; refuses anything that is not one."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"configuration table exceeds {max_rows} rows")
    return rows


def grown(df: DataFrame) -> DataFrame:
    """A join side with a row per document or more: met by sorting, however small its files look.

    A few megabytes of Parquet hold rows that fill the driver's memory once a static plan broadcasts them.
    """
    return df.hint("merge")


def dealt(df: DataFrame, key: str, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt by ``key`` so that a task gets ``task_rows`` of the ``rows`` documents, however narrow they are.

    Adaptive execution joins partitions up to 64 MB of shuffled bytes. Where each document then grows into a dozen
    fields and verdicts that are sorted in the same task, that is millions of rows and most of them are spilled.
    A stage that reads a dealt side keeps its number of partitions, and so do the other sides that it meets there.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))
    return df.repartition(parts, key)


def join_inside(left: DataFrame, right: DataFrame, key: str | Sequence[str], inner: Sequence[str], how: str = "left") -> DataFrame:
    """``left.join(right, [*key, *inner], how)`` dealt by ``key`` (a column or several) alone.

    The rows of a key are few (rules of a document, fields of its type), so both sides may stay where the key
    put them: rows already dealt by it are neither shuffled nor sorted again. The ``inner`` columns are compared
    pair by pair, as neither smaller nor larger, since an equality would become a part of the join's key.
    """
    keys = [key] if isinstance(key, str) else list(key)
    other = right.withColumnsRenamed({c: f"_in_{c}" for c in (*keys, *inner)})
    same = reduce(and_, [left[c] == F.col(f"_in_{c}") for c in keys])
    for c in inner:
        same = same & (left[c] <= F.col(f"_in_{c}")) & (left[c] >= F.col(f"_in_{c}"))
    met = left.join(grown(other), same, how)
    if how == "full_outer":
        met = met.withColumns({c: F.coalesce(left[c], F.col(f"_in_{c}")) for c in (*keys, *inner)})
    return met if how in ("left_semi", "left_anti") else met.drop(*[f"_in_{c}" for c in (*keys, *inner)])


def ordered(df: DataFrame, *by: Column | str) -> DataFrame:
    """``df.orderBy(*by)`` whose rows are made once.

    Ranges of a sort are found by a pass over its input before the pass that sorts; with a shuffle by the columns
    named in ``by`` in between, that first pass reads shuffled rows instead of running all that makes them.
    """
    return df.repartition(*[b for b in by if isinstance(b, str)]).orderBy(*by)


def first_row(df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]) -> DataFrame:
    """First row per key by an order expression, as a map-side combinable aggregate."""
    packed = F.struct(*[F.col(c) for c in columns])
    picked = df.groupBy(*keys).agg(F.min_by(packed, order).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])


def substrings(text: Column, lengths: Column) -> Column:
    """Distinct substrings of the text having one of the given lengths."""
    def of_length(size: Column) -> Column:
        starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda at: F.substr(text, at, size))

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))
