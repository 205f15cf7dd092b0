"""Registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from placewise.bind import Tables
from placewise.checks.sqlbind import with_bindings
from placewise.session import on_workers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

MODULES = ["sources", "grids", "encoding", "aggregates", "joins", "windows", "scoring", "masks", "plans"]


def check(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            on_workers(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_bindings(sql)
        return fn

    return register


def load_all() -> None:
    for module in MODULES:
        import_module(f"placewise.checks.{module}")
