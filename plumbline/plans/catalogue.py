"""Registered queries: name -> (spark, directory of tables) -> DataFrame, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries are named {name}")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add

    def extend(self, other: Catalogue) -> None:
        for name, fn in other.queries.items():
            self.query(name, other.sql.get(name))(fn)
