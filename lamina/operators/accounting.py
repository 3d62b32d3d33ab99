"""Storage accounting over chunk and dictionary metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizes import index_bytes, value_bytes
from . import dictionary


def max_chunk(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.max("size").alias("max_chunk_size"))


def mean_chunk(chunks: DataFrame) -> DataFrame:
    """Whole bytes per chunk of each column."""
    return chunks.groupBy("column_id").agg(F.expr("cast(sum(size) div count(*) as bigint)").alias("avg_chunk_size"))


def column_sizes(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("row_group_id", "column_id").agg(F.sum("size").alias("size"))


def dictionary_sizes(references: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """(column_id, dict_size): each dictionary a column refers to, once."""
    return references.select("column_id", "dict_id").distinct().join(dictionaries, "dict_id").groupBy("column_id").agg(F.sum("size").alias("dict_size"))


def peers(references: DataFrame) -> DataFrame:
    """(column_id, peer): columns that refer to one dictionary."""
    a = references.select("column_id", "dict_id").distinct()
    return a.join(a.withColumnRenamed("column_id", "peer"), "dict_id").where("column_id <> peer").select("column_id", "peer").distinct()


def mean_nonzero(c: Column) -> Column:
    """Integer mean over the samples that are not 0."""
    return F.coalesce(F.sum(c) / F.count_if(c != 0), F.lit(0)).cast("long")


def study(df: DataFrame, pos: str, columns: list[str], unit: int, fixed: int) -> DataFrame:
    """(column, plain, local, fixed, global, best): one row per column, sizes of each strategy. One scan: a cell becomes
    a row for each strategy, counted by scope and value before anything moves."""
    named = dictionary.strategies(pos, unit, fixed)
    scopes = [F.struct(F.lit(k).alias("strategy"), (v[0] if v else F.lit(0)).cast("long").alias("scope")) for k, v in named.items()]
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), value_bytes(F.col(c), df.schema[c].dataType).alias("bytes")) for c in columns]
    flat = df.select(F.explode(F.array(*scopes)).alias("s"), F.array(*cells).alias("cells")).select("s.strategy", "s.scope", F.inline("cells"))
    per = flat.groupBy("column", "strategy", "scope", "value").agg(F.count("*").alias("m"), F.max("bytes").alias("bytes"))
    size = per.groupBy("column", "strategy", "scope").agg(F.sum("m").alias("n"), F.count("value").alias("entries"), F.sum("bytes").alias("dict_size"), F.sum(F.col("bytes") * F.col("m")).alias("plain"))
    cost = F.col("dict_size") + F.col("n") * index_bytes(F.col("entries"))
    out = size.groupBy("column").agg(*(F.sum(F.when(F.col("strategy") == k, F.col("plain") if c == "plain" else cost)).alias(c) for c, k in (("plain", "global"), ("local", "local"), ("fixed", "fixed"), ("global", "global"))))
    costs = F.array(*(F.struct(F.col(k).alias("cost"), F.lit(k).alias("name")) for k in ("fixed", "global", "local", "plain")))
    return out.withColumn("best", F.array_min(costs)["name"])
