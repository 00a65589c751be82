"""Shared pieces: inputs, bound names inside column expressions, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word separators of all word-based operators (a word is a run of anything else).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; an own one only where that is unset.

    In local mode that is a temporary folder, on a cluster a folder of the warehouse, which all executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        configured = tempfile.mkdtemp(prefix="llm-shared-") if spark.sparkContext.master.startswith("local") else f"{warehouse}/llm-shared"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that ran on it, not the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, value: Column, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``value`` as a column that is computed once per row.

    A plain ``withColumn`` is merged into later projections and computed again for every mention,
    which costs dearly for array functions; a generator is a boundary that the optimizer keeps.
    """
    return df.select(*(keep if keep is not None else ["*"]), F.explode(F.array(value)).alias(name))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, out of the way of the names that an operator adds."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def unpacked(df: DataFrame, row: str, like: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The columns of ``like`` from the struct ``row``, those in ``made`` replaced."""
    return df.select(*[(made[c] if c in made else F.col(row)[c]).alias(c) for c in like.columns])


def ordered_by(df: DataFrame, row: str) -> Column:
    """The struct ``row`` as a sort key; as JSON where a part of it has no order."""
    kind = df.schema[row].dataType.simpleString()
    return F.to_json(row) if "map<" in kind or "variant" in kind else F.col(row)


def words_of(text: Column) -> Column:
    """Words of a text (null: none) as an array of strings."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def row_key(*columns: Column) -> Column:
    """64-bit key of a row's content; equal rows share it, nulls and empty strings differ."""
    return F.xxhash64(*[F.struct(c.isNull(), c) for c in columns])


def let(value: Column, body) -> Column:
    """``body`` of a value computed once, for use inside a lambda, where ``staged`` is out of reach."""
    return F.transform(F.array(value), body)[0]


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)
