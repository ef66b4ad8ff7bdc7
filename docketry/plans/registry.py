"""All queries of the library but those of the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.plans import audit, cases, conditions, evaluation, more, releases, retrieval, sessions, structure, validation

MODULES = [retrieval, conditions, audit, cases, sessions, more, validation, evaluation, structure, releases]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
