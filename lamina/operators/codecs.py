"""Block codecs and checksums on bytes, Arrow batch by batch."""

from __future__ import annotations

import gzip
import hashlib

import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("none", "lz4", "zstd", "gzip")


def compress(data: bytes, codec: str) -> bytes:
    """A size of 8 bytes goes first where the codec needs it to decode."""
    if codec == "none":
        return data
    if codec == "lz4":
        return len(data).to_bytes(8, "little") + pa.compress(data, "lz4_raw", asbytes=True)
    if codec == "zstd":
        return zstandard.compress(data)
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    raise ValueError(f"unknown codec {codec!r}")


def decompress(data: bytes, codec: str) -> bytes:
    if codec == "none":
        return data
    if codec == "lz4":
        return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "lz4_raw", asbytes=True)
    if codec == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if codec == "gzip":
        return gzip.decompress(data)
    raise ValueError(f"unknown codec {codec!r}")


def ipc_compress(array: pa.Array) -> bytes:
    """An Arrow IPC stream with LZ4 bodies."""
    sink = pa.BufferOutputStream()
    batch = pa.record_batch([array], ["v"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def ipc_decompress(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column("v").combine_chunks()


def _on_bytes(fn, codec: str):
    @F.pandas_udf(T.BinaryType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else fn(bytes(x), codec))

    return run


def compressed(c: Column, codec: str) -> Column:
    return _on_bytes(compress, codec)(c)


def decompressed(c: Column, codec: str) -> Column:
    return _on_bytes(decompress, codec)(c)


@F.pandas_udf(T.LongType())
def xxh64(s: pd.Series) -> pd.Series:
    """xxHash64 with seed 0, as a signed integer; Spark's own function has seed 42."""
    return s.map(lambda x: None if x is None else int.from_bytes(xxhash.xxh64_digest(bytes(x)), "big", signed=True))


def unit_bytes(df: DataFrame, pos: str, value: str, unit: int) -> DataFrame:
    """(unit_id, data): a unit's values as text, one after another; bounded by the unit."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.coalesce(F.col(value).cast("string"), F.lit("\0")).alias("v")))), lambda x: x["v"])
    return df.groupBy(F.floor(F.col(pos) / unit).cast("long").alias("unit_id")).agg(F.array_join(parts, "\n").alias("data"))


def checksums(units: DataFrame) -> DataFrame:
    return units.select("unit_id", F.md5(F.col("data").cast("binary")).alias("checksum"))


def verified(units: DataFrame, stored: DataFrame) -> DataFrame:
    """(unit_id, valid): false for a wrong checksum and for one that is missing."""
    again = checksums(units).withColumnRenamed("checksum", "again")
    return again.join(stored, "unit_id", "left").select("unit_id", F.coalesce(F.col("again") == F.col("checksum"), F.lit(False)).alias("valid"))


def require_valid(checked: DataFrame) -> DataFrame:
    """The same rows; the job fails at an invalid one."""
    return checked.withColumn("valid", F.when(F.col("valid"), True).otherwise(F.raise_error(F.concat(F.lit("checksum mismatch in unit "), F.col("unit_id").cast("string"))).cast("boolean")))


SQL_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "binary": "BLOB"}


def sql_name(kind: str) -> str:
    return sql_name(kind[6:-1]) + "[]" if kind.startswith("array<") else SQL_NAMES.get(kind, kind)


def schema_checksum(df: DataFrame) -> str:
    """MD5 of names and SQL types, in order."""
    return hashlib.md5(",".join(f"{n} {sql_name(k)}" for n, k in df.dtypes).encode()).hexdigest()
