"""Queries of the reference's operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirelake.plans import evidence, pages, relational, texts


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.QUERIES["temporal_metrics"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.QUERIES | texts.QUERIES | pages.QUERIES | evidence.QUERIES


def oracle_sql() -> dict[str, str]:
    return relational.SQL | texts.SQL | pages.SQL | evidence.SQL
