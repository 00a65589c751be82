"""DuckDB SQL for the registered queries."""

from __future__ import annotations

import importlib

PARTS = ("scalar", "config", "extraction", "rules", "evidence", "canonical", "views", "scoring", "runlog", "ledger", "learnings", "audit")


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for part in PARTS:
        found.update(importlib.import_module(f"oracles.{part}").SQL)
    return found
