"""Registers queries with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import read_table


class Tables:
    """Attribute access to the tables of a directory: ``t.orders``."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(Tables(spark, d))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return register
