"""All queries by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def modules() -> list:
    from assay.plans import decisions, evaluate, exports, graph, ledger, lexical, spans, streaming, upkeep

    return [lexical, spans, decisions, ledger, graph, evaluate, exports, streaming, upkeep]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in modules() for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["baseline_decision"](spark, sf_dir)
