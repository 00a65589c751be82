"""What the entry module registers: the queries of this subpackage, the pipeline and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import queries
from .sql import ORACLE_SQL

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}

__all__ = ["QUERIES", "ORACLE_SQL"]
