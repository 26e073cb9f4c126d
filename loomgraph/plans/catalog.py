"""All queries over the given tables, by name, each with the SQL that states it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import graph_queries, ops_queries, score_queries, text_queries, workbook_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_queries.best_relation(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return text_queries.QUERIES | graph_queries.QUERIES | ops_queries.QUERIES | score_queries.QUERIES | workbook_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.ORACLE | graph_queries.ORACLE | ops_queries.ORACLE | score_queries.ORACLE | workbook_queries.ORACLE
