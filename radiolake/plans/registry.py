"""Queries by name, and the same in DuckDB SQL."""

from __future__ import annotations

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
