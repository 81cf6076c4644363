"""Registered queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scrivia.plans import q_chunks, q_registry, q_retrieval, q_text

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (q_text, q_registry, q_retrieval, q_chunks)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_retrieval.evaluated(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: query for m in MODULES for name, (query, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
