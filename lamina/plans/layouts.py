"""Row groups, units, chunks and their rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounting, layout
from .registry import GROUP, UNIT, query

U, PER = UNIT, -(-GROUP // UNIT)
COLUMNS = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
LIMIT = 12_000  # bytes of a chunk, so that a row group of the small tables has several
_BYTES = ("8", "octet_length(encode(o_orderstatus)) + 4", "octet_length(encode(o_orderpriority)) + 4")
_UNITS = " UNION ALL ".join(f"SELECT {i}::INTEGER AS column_id, floor(floor(o_orderkey / {U}) / {PER})::BIGINT AS row_group_id, floor(o_orderkey / {U})::BIGINT AS unit_id, count(*) AS num_rows, sum({b})::BIGINT AS bytes FROM orders GROUP BY 2, 3" for i, b in enumerate(_BYTES))


def _cut(limit: int) -> str:
    return f"""u AS ({_UNITS}), o AS (SELECT *, row_number() OVER (PARTITION BY column_id, row_group_id ORDER BY unit_id) AS r FROM u),
c(column_id, row_group_id, unit_id, num_rows, bytes, r, chunk_id, next, total) AS (
SELECT column_id, row_group_id, unit_id, num_rows, bytes, r, 0::BIGINT, CASE WHEN bytes > {limit} THEN 1 ELSE 0 END::BIGINT, CASE WHEN bytes > {limit} THEN 0 ELSE bytes END::BIGINT FROM o WHERE r = 1
UNION ALL SELECT o.column_id, o.row_group_id, o.unit_id, o.num_rows, o.bytes, o.r, c.next, CASE WHEN c.total + o.bytes > {limit} THEN c.next + 1 ELSE c.next END, CASE WHEN c.total + o.bytes > {limit} THEN 0 ELSE c.total + o.bytes END FROM c JOIN o ON o.column_id = c.column_id AND o.row_group_id = c.row_group_id AND o.r = c.r + 1)"""


_CHUNKS = f"WITH RECURSIVE {_cut(LIMIT)}, k AS (SELECT column_id, row_group_id, chunk_id, sum(num_rows)::BIGINT AS num_rows, sum(bytes)::BIGINT AS size FROM c GROUP BY 1, 2, 3) SELECT *, (sum(size) OVER (ORDER BY row_group_id, column_id, chunk_id) - size)::BIGINT AS \"offset\" FROM k"


def _units(t):
    return layout.units(t("orders"), "o_orderkey", COLUMNS, U, GROUP)


def _chunks(t, limit=LIMIT):
    return layout.chunks(_units(t), limit)


@query("W02_layout", f"SELECT o_orderkey, floor(o_orderkey / {U})::BIGINT AS batch_id, floor(floor(o_orderkey / {U}) / {PER})::BIGINT AS row_group_id FROM orders")
def _(t):
    return layout.placed(t("orders").select("o_orderkey"), "o_orderkey", U, GROUP)


@query("W05_open_chunk_bytes", f"WITH RECURSIVE {_cut(LIMIT)} SELECT column_id, sum(bytes)::BIGINT AS memory FROM c JOIN (SELECT max(row_group_id) AS g FROM c) ON row_group_id = g GROUP BY 1, chunk_id QUALIFY row_number() OVER (PARTITION BY column_id ORDER BY chunk_id DESC) = 1")
def _(t):
    found = _chunks(t)
    last = found.groupBy("column_id").agg(F.max(F.struct("row_group_id", "chunk_id", "size")).alias("x"))
    return last.select("column_id", F.col("x.size").alias("memory"))


@query("W06_row_groups", f"SELECT floor(floor(o_orderkey / {U}) / {PER})::BIGINT AS row_group_id, count(*) AS num_rows, min(o_orderkey) AS first FROM orders GROUP BY 1")
def _(t):
    return layout.placed(t("orders"), "o_orderkey", U, GROUP).groupBy("row_group_id").agg(F.count("*").alias("num_rows"), F.min("o_orderkey").alias("first"))


@query("W07_units", _UNITS)
def _(t):
    return _units(t)


@query("W08_custom_units", f"SELECT (floor(o_orderkey / {U}) * 4 + floor((o_orderkey % {U}) / 300))::BIGINT AS unit_id, count(*) AS num_rows FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(layout.unit_id("o_orderkey", U, 300).alias("unit_id")).agg(F.count("*").alias("num_rows"))


@query("W09_chunk_cut", f"WITH RECURSIVE {_cut(LIMIT)} SELECT column_id, row_group_id, unit_id, num_rows, bytes, chunk_id FROM c")
def _(t):
    return layout.cut_chunks(_units(t), LIMIT)


@query("I16_small_chunks", f"WITH RECURSIVE {_cut(4096)} SELECT column_id, row_group_id, unit_id, num_rows, bytes, chunk_id FROM c")
def _(t):
    return layout.cut_chunks(_units(t), 4096)


@query("W10_chunk_offsets", _CHUNKS)
def _(t):
    return _chunks(t)


@query("W11_row_group_rollup", f'SELECT row_group_id, min("offset") AS "offset", sum(size)::BIGINT AS size, (max(num_rows))::BIGINT AS num_rows FROM (SELECT row_group_id, column_id, min("offset") AS "offset", sum(size) AS size, sum(num_rows) AS num_rows FROM ({_CHUNKS}) GROUP BY 1, 2) GROUP BY 1')
def _(t):
    per = _chunks(t).groupBy("row_group_id", "column_id").agg(F.min("offset").alias("offset"), F.sum("size").alias("size"), F.sum("num_rows").alias("num_rows"))
    return per.groupBy("row_group_id").agg(F.min("offset").alias("offset"), F.sum("size").alias("size"), F.max("num_rows").alias("num_rows"))


@query("W12_column_metadata", f"SELECT column_id, count(*) AS chunks, sum(size)::BIGINT AS size FROM ({_CHUNKS}) GROUP BY 1")
def _(t):
    return _chunks(t).groupBy("column_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("size"))


@query("A01_max_chunk", f"SELECT max(size) AS max_chunk_size FROM ({_CHUNKS})")
def _(t):
    return accounting.max_chunk(_chunks(t))


@query("A02_mean_chunk", f"SELECT column_id, floor(sum(size) / count(*))::BIGINT AS avg_chunk_size FROM ({_CHUNKS}) GROUP BY 1")
def _(t):
    return accounting.mean_chunk(_chunks(t))


@query("A03_column_sizes", f"SELECT row_group_id, column_id, sum(size)::BIGINT AS size FROM ({_CHUNKS}) GROUP BY 1, 2")
def _(t):
    return accounting.column_sizes(_chunks(t))


@query("I14_row_group_sweep", " UNION ALL ".join(f"SELECT {n}::BIGINT AS group_rows, count(DISTINCT floor(floor(o_orderkey / {U}) / {-(-n // U)})) AS groups FROM orders" for n in (2048, 4096, 8192)))
def _(t):
    sizes = (2048, 4096, 8192)
    row = t("orders").agg(*(F.countDistinct(layout.row_group(F.floor(F.col("o_orderkey") / U), U, n)).alias(str(n)) for n in sizes))
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).cast("long").alias("group_rows"), F.col(str(n)).alias("groups")) for n in sizes))))


_KIND = "CASE {0} WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'FLOAT' THEN 'float' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' END"
_DESCRIBED = "SELECT row_number() OVER () AS r, column_name AS c, replace(column_type, '[]', '') AS k, column_type LIKE '%[]' AS list FROM (DESCRIBE embeddings)"


@query("W22_physical_columns", f"WITH d AS ({_DESCRIBED}), p AS (SELECT r, 0 AS o, c AS path, CASE WHEN list THEN 'list' ELSE {_KIND.format('k')} END AS kind FROM d UNION ALL SELECT r, 1, c || '.item', {_KIND.format('k')} FROM d WHERE list) SELECT (row_number() OVER (ORDER BY r, o) - 1)::INTEGER AS column_id, path, kind FROM p")
def _(t):
    return t.spark.createDataFrame(layout.physical_columns(t("embeddings").schema), "column_id int, path string, kind string")
