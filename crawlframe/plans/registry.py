"""Registration of queries: a name, a function of (spark, sf_dir), and the SQL that states its result."""

from __future__ import annotations

FOUND: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        FOUND[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put
