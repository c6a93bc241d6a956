"""Queries over the driver tables, each with an SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Tables` under an operator name."""

    def keep(fn):
        from gleaner.plans.tables import Tables

        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, path: fn(Tables(spark, path))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def load_all() -> None:
    """Import every module of queries."""
    import importlib
    import pkgutil

    import gleaner.plans as here

    for m in pkgutil.iter_modules(here.__path__):
        if m.name != "tables":
            importlib.import_module(f"gleaner.plans.{m.name}")
