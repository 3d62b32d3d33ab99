"""The size model, in bytes, and bit widths. Every rule is a plain expression, so SQL can check it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIXED = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8}


def value_bytes(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value stored plainly; a null takes none, a string its bytes and a 4-byte length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c) + 4, F.lit(0)).cast("long")
    return F.when(c.isNull(), 0).otherwise(FIXED[type(kind)]).cast("long")


def index_bytes(entries: Column) -> Column:
    """Width of the codes of a dictionary: 1, 2, 4 or 8 bytes."""
    return F.when(entries < 1 << 8, 1).when(entries < 1 << 16, 2).when(entries < 1 << 32, 4).otherwise(8).cast("long")


def bit_width(c: Column) -> Column:
    """Bits of the largest value: 32 or 64 less its leading zeros."""
    return F.when(c == 0, 0).otherwise(F.length(F.bin(c))).cast("long")


def packed_bytes(n: Column, width: Column) -> Column:
    return F.ceil(n * width / 8).cast("long")
