"""How a module of queries collects them."""

from __future__ import annotations

from collections.abc import Callable

from .facts import for_duckdb


class Queries:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        """Register a function under its name; sql: what DuckDB runs for the same rows."""

        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = for_duckdb(sql)
            return f

        return keep
