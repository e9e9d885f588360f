"""Named queries, each with its equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Collects queries; a decorated function takes ``t``, which reads a table by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(build: Callable) -> Callable:
            name = build.__name__

            def run(spark: SparkSession, folder: str) -> DataFrame:
                return build(lambda table_name: table(spark, folder, table_name))

            run.__name__ = name
            self.queries[name] = run
            if sql:
                self.sql[name] = sql
            return build

        return add
