"""Where queries over the stand-ins are registered, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Fixtures, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, *sql: str) -> Callable:
    """Register a function of the stand-ins under a name; the last of sql is the oracle's query, those before are tables it uses."""

    def put(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Fixtures(spark, sf_dir))
        if sql:
            SQL[name] = oracle(*sql)
        return build

    return put
