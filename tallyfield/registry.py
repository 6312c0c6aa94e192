"""Named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .session import ship_library

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with its SQL where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            @wraps(f)
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship_library(spark)
                return f(spark, sf_dir)

            self.queries[name] = f if hasattr(f, "__wrapped__") else run
            if sql is not None:
                self.sql[name] = sql
            return f

        return add

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.query(name, sql)(query)

    def merge(self, other: "Registry") -> None:
        for name, query in other.queries.items():
            self.add(name, query, other.sql.get(name))
