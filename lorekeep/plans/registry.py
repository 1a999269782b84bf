"""Where queries are registered with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: DuckDB's counterpart of functions.text.norm_term.
NORM = "lower(strip_accents(trim({})))"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
