"""Registry of runnable queries: name, Spark callable over a data folder, DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trawlkit.plans.fixtures import Crawl, duckdb_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, make: Callable[[Crawl], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name!r} is registered already")
    QUERIES[name] = lambda spark, folder: make(Crawl(spark, folder))
    if sql is not None:
        ORACLES[name] = duckdb_sql(sql)


def query(name: str, sql: str | None = None):
    """Decorator form of `add`."""

    def wrap(make: Callable[[Crawl], DataFrame]):
        add(name, make, sql)
        return make

    return wrap
