"""Where queries are registered: a name, a function of the store, and SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.corpus import PRELUDE, Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(store)`` under ``name``; ``sql`` follows the tables of the prelude, so it starts
    with SELECT, or with a comma and further common table expressions."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(Store(spark, sf_dir))
        if sql:
            start = PRELUDE.replace("WITH ", "WITH RECURSIVE ", 1) if "\nwalk(" in sql else PRELUDE
            SQL[name] = f"{start}\n{sql}"
        return f

    return add
