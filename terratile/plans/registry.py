"""The queries and their SQL, filled by the modules beside this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terratile.plans.bindings import bind, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, check: str):
    """Registers f(bind) -> DataFrame, where bind(name) gives a bound table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: bind(spark, sf_dir, table))
        SQL[name] = sql(check)
        return f

    return add
