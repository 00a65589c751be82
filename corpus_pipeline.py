"""From raw documents to packed training sequences, one table after the other.

Each stage reads what its predecessor kept and wrote, whole; all but the last return the columns of
``documents``. Rejected documents and removed lines are gone, one document of each group of near copies
stays, secrets are masked, the mix repeats or cuts documents by source, and packing places every piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.common import materialize, table, tokenizer_file
from auditloom.llm.mixing import mixed_documents
from auditloom.llm.near_dedup import keep_one
from auditloom.llm.packing import pack
from auditloom.llm.quality_rules import clean
from auditloom.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("secret scan", secret_scan),
          ("mix sources", mix_sources), ("best-fit packing", packing)]

#: Shingle links, hash-random cuts and token ids have no SQL form; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{number}")
    return docs
