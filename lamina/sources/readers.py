"""Scans and sinks: Parquet, ORC, CSV, JSON lines, raw bytes; schemas from a JSON description."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Scan:
    """What to read: a path, columns by index or name, and rows by position. Pruning and pushdown are left to Catalyst."""

    path: str
    format: str = "parquet"
    columns: Sequence[int | str] | None = None
    rows: Sequence[int] | None = None
    options: dict[str, str] = field(default_factory=dict)

    def load(self, spark: SparkSession) -> DataFrame:
        df = spark.read.format(self.format).options(**self.options).load(self.path)
        names = df.columns if self.columns is None else [df.columns[c] if isinstance(c, int) else c for c in self.columns]
        if self.rows is not None:  # pushed down to the reader as a filter on the position in the file
            df = df.where(F.col("_metadata.row_index").isin(*self.rows))
        return df.select(*names)


_SIMPLE = {"varchar": T.StringType(), "string": T.StringType(), "float": T.FloatType(), "double": T.DoubleType(), "integer": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampNTZType(), "json": T.StringType(), "binary": T.BinaryType()}


def json_type(spec: str | dict) -> T.DataType:
    """A type from its JSON description: a name, or a struct / list. Maps are refused: they are lists of structs."""
    kind = spec if isinstance(spec, str) else spec["type"]
    if kind in _SIMPLE:
        return _SIMPLE[kind]
    if kind == "struct":
        return T.StructType([T.StructField(f["name"], json_type(f["type"]), True) for f in spec["fields"]])
    if kind in ("list", "array"):
        return T.ArrayType(json_type(spec["element"]), True)
    raise ValueError(f"unsupported type {kind!r}")


def json_schema(fields: list[dict]) -> T.StructType:
    return json_type({"type": "struct", "fields": fields})


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", null: str = "NULL") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, nullValue=null, header=False, mode="DROPMALFORMED")


def write_csv(df: DataFrame, path: str, sep: str = "|", null: str = "NULL") -> None:
    df.write.csv(path, sep=sep, nullValue=null, header=False)


def rewrite_parquet(df: DataFrame, path: str, rows_per_group: int, compression: str = "snappy") -> None:
    """Parquet with at most so many rows in a row group."""
    df.write.option("compression", compression).option("parquet.block.row.count.limit", str(rows_per_group)).parquet(path)


def merged(frames: Sequence[DataFrame], order: str, limit: int | None = None) -> DataFrame:
    """All rows of files under the first one's schema, or the first ``limit`` in order."""
    first = frames[0]
    out = first
    for f in frames[1:]:
        out = out.unionByName(f.select(*(F.col(x.name).cast(x.dataType).alias(x.name) for x in first.schema.fields)))
    return out if limit is None else out.orderBy(order).limit(limit)


def map_entries(c: str) -> F.Column:
    """A map as a list of (key, value) structs ordered by key; a null map stays null."""
    return F.array_sort(F.map_entries(c))


def retyped(df: DataFrame) -> DataFrame:
    """Decimals to doubles, dates and timestamps to days since 1970."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.datediff(c, F.lit("1970-01-01").cast("date"))
        out.append(c.alias(f.name))
    return df.select(*out)


def wide(spark: SparkSession, columns: int, rows: int = 8, value: float = 42.0) -> DataFrame:
    return spark.range(rows).select(*(F.lit(value).alias(f"column_{i}") for i in range(columns)))
