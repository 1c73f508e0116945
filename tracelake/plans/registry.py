"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

from tracelake.plans import compare_queries, signal_queries, source_queries, span_queries, usage_queries

_PARTS = (span_queries, signal_queries, usage_queries, compare_queries, source_queries)

QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
