"""How a query is registered: its name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLE: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UNIT = 1024  # values of an encoding unit in the registered queries, so that small tables span several
GROUP = 4000  # rows after which a row group closes


def query(name: str, sql: str | None = None):
    """Register a function of a table reader: ``t("orders")`` is a DataFrame."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def t(table: str) -> DataFrame:
                return spark.read.parquet(f"{sf_dir}/{table}.parquet")

            t.spark, t.dir = spark, sf_dir
            return fn(t)

        TABLE[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return put
