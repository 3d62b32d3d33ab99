"""Scans as users set them up, container metadata, and whole-file checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codecs
from ..sources import footers, readers
from .registry import query


@query("S02_reader_options", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    options = {"mergeSchema": "false", "pathGlobFilter": "*.parquet"}
    return readers.Scan(f"{t.dir}/orders.parquet", columns=["o_orderkey", "o_orderstatus"], options=options).load(t.spark)


@query("S03_postscript")
def _(t):
    return footers.postscripts(t.spark, f"{t.dir}/orders.parquet")


@query("S04_footer")
def _(t):
    return footers.footers(t.spark, f"{t.dir}/lineitem.parquet")


@query("S04b_footer_rows", "SELECT 'lineitem' AS \"table\", count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def _(t):
    out = None
    for name in ("lineitem", "orders"):
        own = footers.footers(t.spark, f"{t.dir}/{name}.parquet").where("column_id = 0").agg(F.sum("num_rows").alias("n"))
        own = own.select(F.lit(name).alias("table"), "n")
        out = own if out is None else out.unionAll(own)
    return out


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


@query("S12_object_store_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (5, 777, 1234)")
def _(t):
    return readers.Scan(_uri(f"{t.dir}/orders.parquet"), columns=[0, 3], rows=[5, 777, 1234]).load(t.spark)


@query("S14_names_and_row_ids", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderkey IN (0, 9, 1023, 1024, 1300)")
def _(t):
    return readers.Scan(f"{t.dir}/orders.parquet", columns=["o_orderkey", "o_orderpriority", "o_totalprice"], rows=[0, 9, 1023, 1024, 1300]).load(t.spark)


@query("S15_projected_scan", "SELECT l_orderkey, l_extendedprice, l_returnflag FROM lineitem")
def _(t):
    return readers.Scan(f"{t.dir}/lineitem.parquet", columns=["l_orderkey", "l_extendedprice", "l_returnflag"]).load(t.spark)


_FIELDS = [{"name": "a", "type": "varchar"}, {"name": "b", "type": "float"}, {"name": "c", "type": "double"}, {"name": "d", "type": "integer"}, {"name": "e", "type": "bigint"}, {"name": "f", "type": "boolean"}, {"name": "g", "type": "timestamp"},
           {"name": "h", "type": {"type": "struct", "fields": [{"name": "x", "type": "integer"}, {"name": "y", "type": "varchar"}]}}, {"name": "i", "type": {"type": "list", "element": "double"}}, {"name": "j", "type": "json"}, {"name": "k", "type": "binary"}]


@query("S18_json_schema", "SELECT * FROM (VALUES ('a', 'string'), ('b', 'float'), ('c', 'double'), ('d', 'int'), ('e', 'bigint'), ('f', 'boolean'), ('g', 'timestamp_ntz'), ('h', 'struct<x:int,y:string>'), ('i', 'array<double>'), ('j', 'string'), ('k', 'binary')) v(name, kind)")
def _(t):
    return t.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in readers.json_schema(_FIELDS)], "name string, kind string")


@query("A12_layout_statistics")
def _(t):
    """Per file: what its column chunks are written with. Pages aren't listed in footers; a dictionary page is told."""
    found = footers.footers(t.spark, f"{t.dir}/*.parquet").withColumn("encoding", F.explode("encodings"))
    sets = (F.sort_array(F.collect_set(c)).alias(f"{c}s") for c in ("encoding", "compression", "page_type"))
    pages = F.explode(F.when(F.col("dictionary"), F.array(F.lit("data"), F.lit("dictionary"))).otherwise(F.array(F.lit("data"))))
    return found.withColumn("page_type", pages).groupBy("file", "version", "created_by").agg(*sets)


@query("A13_chunk_bytes")
def _(t):
    """Per row group: compressed bytes of each column's chunk."""
    found = footers.footers(t.spark, f"{t.dir}/lineitem.parquet")
    return found.groupBy("column_id", "path").agg(F.sort_array(F.collect_list(F.struct("file", "row_group_id", "size"))).alias("chunks"), F.expr("sum(size) div count(*)").alias("mean_size"))


@query("C10_file_checksum")
def _(t):
    return footers.checksums(t.spark, f"{t.dir}/*.parquet")


_TABLES = ("orders", "lineitem", "documents", "embeddings")


@query("C11_schema_checksum", " UNION ALL ".join(f"SELECT '{n}' AS \"table\", md5(string_agg(column_name || ' ' || column_type, ',')) AS checksum FROM (DESCRIBE {n})" for n in _TABLES))
def _(t):
    return t.spark.createDataFrame([(n, codecs.schema_checksum(t(n))) for n in _TABLES], "table string, checksum string")
