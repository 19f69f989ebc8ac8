"""Registering a query with its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """(queries, oracles, decorator): @query(sql) registers a function by its name; no sql, no oracle."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
