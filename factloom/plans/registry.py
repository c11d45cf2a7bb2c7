"""The queries of the code-intelligence operators over the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from . import code_queries, graph_queries, resolve_queries, source_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (graph_queries, resolve_queries, text_queries, code_queries, source_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
