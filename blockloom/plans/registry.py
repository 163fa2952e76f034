"""Collects queries by name, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Query] = {}
        self.SQL: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Registers a function of Tables under its own name."""

        def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                self.SQL[f.__name__] = sql
            return f

        return register
