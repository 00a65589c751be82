"""Named queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        return fn

    return register


def load_all() -> dict[str, Query]:
    from . import (  # noqa: F401
        queries_audit,
        queries_canonical,
        queries_config,
        queries_evidence,
        queries_extraction,
        queries_ledger,
        queries_learnings,
        queries_rules,
        queries_runlog,
        queries_scalar,
        queries_scoring,
        queries_views,
    )

    return dict(QUERIES)
