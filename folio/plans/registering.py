"""Registers a query beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    """QUERIES and ORACLES of a module, filled by decorating each query with its SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str) -> Callable[[Callable], Callable]:
        def add(query: Callable) -> Callable:
            self.queries[query.__name__], self.oracles[query.__name__] = query, sql
            return query

        return add
