"""A decorator that files a query and its SQL under the function's name."""

from __future__ import annotations

from collections.abc import Callable


def registrar() -> tuple[dict, dict[str, str], Callable]:
    queries: dict = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def take(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return take

    return queries, sqls, query
