"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import catalog, container, decoders, layouts, nested  # noqa: F401  (each registers its queries)
from .registry import SQL, TABLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TABLE["D14_dictionary_decode"](spark, sf_dir)


def queries() -> dict:
    return dict(TABLE)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
