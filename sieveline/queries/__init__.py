"""Registry of the engine's queries: each module of this package offers QUERIES and ORACLES by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sieveline.queries import evidence, lists, maps, models, planning, retrieval, scope, studies

MODULES = (evidence, retrieval, maps, models, studies, lists, planning, scope)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
