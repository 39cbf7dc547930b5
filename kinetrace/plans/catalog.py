"""Every query of the library's own operators, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinetrace.plans import aggregate_queries, function_queries, incremental_queries, join_queries, table_queries, window_queries

MODULES = [aggregate_queries, function_queries, incremental_queries, join_queries, table_queries, window_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_queries.forecast_baselines(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
