"""Named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, fn: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = fn
        if oracle is not None:
            self.sql[name] = oracle

    def query(self, oracle: str | None = None, name: str | None = None):
        def deco(fn: Query) -> Query:
            self.add(name or fn.__name__, fn, oracle)
            return fn

        return deco
