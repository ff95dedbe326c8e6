"""Registry of queries and of the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a (spark, folder) -> DataFrame function, by default under its own name."""
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return add
