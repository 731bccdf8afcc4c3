"""The registry of named queries: name -> function (spark, folder) -> DataFrame, and name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function as query `name`, checked against `sql` where SQL can express it."""

        def keep(query: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return keep
