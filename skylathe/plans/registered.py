"""How the modules of queries list them."""

from __future__ import annotations

from collections.abc import Callable


def register() -> tuple[dict, dict, Callable]:
    """Queries by name, their SQL by name, and a decorator that adds a function (spark, folder) and its SQL."""
    queries, oracles = {}, {}

    def query(sql: str = "") -> Callable:
        def add(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
