"""Writing canonical tables, workbooks and per-document results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..plans.canonical import stringify_all


def table_sink(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """``replace`` clears and writes, ``append`` adds rows."""
    if mode not in ("replace", "append"):
        raise ValueError("table sink only supports replace or append mode")
    writer = df.write.mode("overwrite" if mode == "replace" else "append").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("emptyValue", "")
    writer.save(path)


def write_canonical(summary: DataFrame, results: DataFrame, folder: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Both canonical tables, as strings, partitioned by document type."""
    table_sink(stringify_all(summary), f"{folder}/canonical_invoice_summary", mode, fmt, ("invoice_type_id",))
    table_sink(stringify_all(results), f"{folder}/canonical_compliance_results", mode, fmt, ("invoice_type_id",))


def write_workbook(tables: dict[str, DataFrame], folder: str, mode: str = "replace", fmt: str = "csv") -> dict[str, str]:
    """Each table under its file name; returns the paths."""
    if not tables:
        raise ValueError("workbook needs at least one table")
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{S.workbook_filename(name)}.csv"
        table_sink(stringify_all(df), paths[name], mode, fmt)
    return paths


def append_run_summary(summary_rows: DataFrame, path: str) -> None:
    """Rolling 17-column summary."""
    table_sink(stringify_all(summary_rows.select(*S.RUN_SUMMARY)), path, "append")


def publish_results(results: DataFrame, outcomes: DataFrame, folder: str, batch_id: int, key: str = "invoice_id") -> None:
    """Results and a status marker of each document of a micro-batch.

    The batch number is part of the path, so a repeated batch replaces itself.
    """
    table_sink(results, f"{folder}/results/batch={batch_id}", "replace")
    table_sink(outcomes.select(key, F.col("outcome").alias("status")), f"{folder}/status/batch={batch_id}", "replace")


def sink_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """rows and cells per table, one distributed count each."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows", (F.col("rows") * len(df.columns)).alias("cells"))
             for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
