"""All queries of the library and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataq.corpus import duck_sql, run_sql

from . import evidence, knowledge, retrieval, upkeep
from .gallery import STATEMENTS


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, sql=sql: run_sql(spark, sf_dir, sql)) for name, sql in STATEMENTS.items()} | retrieval.QUERIES | knowledge.QUERIES | evidence.QUERIES | upkeep.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: duck_sql(sql) for name, sql in STATEMENTS.items()} | retrieval.SQL | knowledge.SQL | evidence.SQL | upkeep.SQL
