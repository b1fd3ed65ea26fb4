"""Where the queries register, each with its SQL beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.graph import Graph, open_graph, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def on_graph(name: str, sql: str | None = None) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    """Registers plan(graph) under a name, with DuckDB SQL over the fixture's views."""

    def add(plan: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plan(open_graph(spark, sf_dir))
        if sql:
            SQL[name] = oracle(sql)
        return plan

    return add


def on_tables(name: str, sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    """Registers plan(spark, sf_dir) under a name, with DuckDB SQL over the base tables."""

    def add(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = plan
        if sql:
            SQL[name] = sql
        return plan

    return add
