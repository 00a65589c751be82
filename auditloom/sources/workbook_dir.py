"""Reading a folder of workbook CSVs back, with its header contract."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S


def header_faults(table: str, columns: list[str]) -> list[str]:
    """What is wrong with a table's columns, by its contract: all of them, or for the open-ended matrix the first ones."""
    contract = dict(S.WORKBOOK_TABLES).get(table)
    open_ended = table == "Compliance Matrix"
    wanted = list(S.MATRIX_KEYS if open_ended else contract or columns)
    given = columns[:len(wanted)] if open_ended else columns
    faults = [f"column {at}: {have!r} instead of {want!r}" for at, (have, want) in enumerate(zip_longest(given, wanted), 1) if have != want]
    if open_ended:
        faults += [f"{c!r} is one of the raw rule IDs, not a label" for c in columns if c.startswith("R_")]
    return faults


def validate_headers(table: str, columns: list[str]) -> None:
    """Refuse a table whose columns break its contract, naming every fault."""
    if faults := header_faults(table, columns):
        raise ValueError(f"{table}: stale or invalid headers ({'; '.join(faults)})")


def scan_workbook_dir(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of the workbook; missing ones are reported together."""
    found: dict[str, DataFrame] = {}
    missing = []
    for table, _ in S.WORKBOOK_TABLES:
        names = [S.workbook_filename(table)]
        if table in S.WORKBOOK_FALLBACKS:
            names.append(S.WORKBOOK_FALLBACKS[table])
        for name in names:
            try:
                found[table] = spark.read.csv(f"{folder}/{name}.csv", header=True, multiLine=True, escape='"', nullValue="\u0000").na.fill("")
                break
            except Exception as error:  # the path does not exist
                if "PATH_NOT_FOUND" not in str(error):
                    raise
        else:
            missing.append(f"{names[0]}.csv")
    if missing:
        raise ValueError(f"no such workbook tables in {folder}: " + ", ".join(missing))
    for table, df in found.items():
        validate_headers(table, df.columns)
    return found
