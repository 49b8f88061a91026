"""Queries by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.queries import data, filters, operations, pipelines, services
from docquarry.queries.base import QUERIES, SQL, Query

MODULES = (filters, pipelines, data, operations, services)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.pl_full(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
