"""Registered queries and their SQL; modules of this package add to them by the decorator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.plans.fixtures import oracle, view

View = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(V), where V(name) is a view over the given tables and V.spark the session; sql: the same for DuckDB."""

    def add(f: Callable[[View], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def v(what: str) -> DataFrame:
                return view(spark, sf_dir, what)

            v.spark, v.sf_dir = spark, sf_dir
            return f(v)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = oracle(sql)
        return f

    return add
