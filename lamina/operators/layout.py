"""Physical layout as relations: batches, row groups, encoding units, chunks and their offsets.

Everything follows from an explicit position; no operator numbers rows in one task. Offsets are running sums over
units, of which there is one for each 64 Ki values of a column.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizes import value_bytes


def row_group(batch_id: Column, batch: int, rows: int) -> Column:
    """A row group closes after the batch that reaches ``rows``: it may overshoot by part of a batch."""
    return F.floor(batch_id / -(-rows // batch)).cast("long")


def placed(df: DataFrame, pos: str, batch: int, group_rows: int) -> DataFrame:
    """``df`` with batch_id and row_group_id."""
    batch_id = F.floor(F.col(pos) / batch).cast("long")
    return df.withColumn("batch_id", batch_id).withColumn("row_group_id", row_group(batch_id, batch, group_rows))


def unit_id(pos: str, batch: int, length: int) -> Column:
    """Encoding units of a custom length within each batch; the last one of a batch may be shorter."""
    per = -(-batch // length)
    return (F.floor(F.col(pos) / batch) * per + F.floor(F.pmod(F.col(pos), F.lit(batch)) / length)).cast("long")


def long_form(df: DataFrame, pos: str, columns: list[str]) -> DataFrame:
    """(column_id, pos, bytes) for each cell: one pass over the table, no union of scans."""
    cells = [F.struct(F.lit(i).cast("int").alias("column_id"), value_bytes(F.col(c), df.schema[c].dataType).alias("bytes")) for i, c in enumerate(columns)]
    return df.select(F.col(pos).alias("pos"), F.inline(F.array(*cells)))


def units(df: DataFrame, pos: str, columns: list[str], batch: int, group_rows: int) -> DataFrame:
    """(column_id, row_group_id, unit_id, num_rows, bytes): what one writer would flush per column and batch."""
    cells = placed(long_form(df, pos, columns), "pos", batch, group_rows)
    return cells.groupBy("column_id", "row_group_id", F.col("batch_id").alias("unit_id")).agg(F.count("*").alias("num_rows"), F.sum("bytes").alias("bytes"))


def cut_chunks(sizes: DataFrame, limit: int) -> DataFrame:
    """chunk_id per unit: a chunk closes once its bytes exceed ``limit``, strictly.

    The sum restarts at each cut, which no window frame expresses; the units of a column and row group are walked once,
    in order. A unit stands for a batch of values, some 64 Ki, so a group of 10**11 rows is 50 MB here.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit_id")
        chunk, total, out = 0, 0, []
        for size in table.column("bytes").to_pylist():
            out.append(chunk)
            total += size
            if total > limit:
                chunk, total = chunk + 1, 0
        return table.append_column("chunk_id", pa.array(out, pa.int64()))

    schema = "column_id int, row_group_id long, unit_id long, num_rows long, bytes long"
    return sizes.select("column_id", "row_group_id", "unit_id", "num_rows", "bytes").groupBy("column_id", "row_group_id").applyInArrow(run, f"{schema}, chunk_id long")


def chunks(sizes: DataFrame, limit: int) -> DataFrame:
    """(column_id, row_group_id, chunk_id, num_rows, size, offset), in the order a writer lays them down."""
    found = cut_chunks(sizes, limit).groupBy("row_group_id", "column_id", "chunk_id").agg(F.sum("num_rows").alias("num_rows"), F.sum("bytes").alias("size"))
    inner = F.sum("size").over(Window.partitionBy("row_group_id").orderBy("column_id", "chunk_id").rowsBetween(Window.unboundedPreceding, -1))
    groups = found.groupBy("row_group_id").agg(F.sum("size").alias("total"))
    before = groups.select("row_group_id", F.coalesce(F.sum("total").over(Window.orderBy("row_group_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return found.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, "row_group_id").select("column_id", "row_group_id", "chunk_id", "num_rows", "size", (F.col("start") + F.col("inner")).alias("offset"))


def selection(positions: DataFrame, groups: DataFrame, stride: int) -> DataFrame:
    """Positions (pos, repeated ones stay) by the row group that holds them: (row_group_id, local, pos); others are skipped.

    Groups and positions meet in strides of positions, by equality: a group has a row for each stride it reaches into,
    so a stride of about a group's rows keeps both sides near their own size.
    """
    reach = F.sequence(F.floor(F.col("start") / stride), F.floor((F.col("start") + F.col("num_rows") - 1) / stride))
    cells = groups.where("num_rows > 0").withColumn("cell", F.explode(reach))
    met = positions.withColumn("cell", F.floor(F.col("pos") / stride)).join(cells, "cell").where("pos >= start and pos < start + num_rows")
    return met.select("row_group_id", (F.col("pos") - F.col("start")).alias("local"), "pos")


def bulk_metadata(columns: Column, projected: Column) -> Column:
    """Whether metadata of all columns is read at once."""
    return (columns <= 100) | (projected / columns > 0.6)


def physical_columns(schema: T.StructType, pushdown: bool = False) -> list[tuple[int, str, str]]:
    """Depth-first numbering of physical columns: (id, path, kind)."""
    out: list[tuple[int, str, str]] = []

    def walk(path: str, kind: T.DataType) -> None:
        if isinstance(kind, T.MapType):
            raise ValueError(f"{path}: maps are not supported; use a list of structs")
        if isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if pushdown and isinstance(inner, T.StructType) and not any(isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) for f in inner.fields):
                out.extend((len(out) + i, f"{path}.{f.name}", "pushed") for i, f in enumerate(inner.fields))
                return
            out.append((len(out), path, "list"))
            walk(f"{path}.item", inner)
        elif isinstance(kind, T.StructType):
            out.append((len(out), path, "struct"))
            for f in kind.fields:
                walk(f"{path}.{f.name}", f.dataType)
        else:
            out.append((len(out), path, kind.simpleString()))

    for f in schema.fields:
        walk(f.name, f.dataType)
    return out
