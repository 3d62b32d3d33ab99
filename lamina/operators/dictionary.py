"""Dictionary encoding at several scopes. A dictionary lists values by first occurrence; null has no entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizes import index_bytes, value_bytes

STRIDE = 1 << 16  # positions that are numbered together


def build(df: DataFrame, value: str, pos: str, scope: list[Column] | None = None) -> DataFrame:
    """(scope, idx, value, first): the smallest position per value is a map-side minimum; only different values are
    numbered, in strides of positions whose counts are summed up, so no task numbers a whole dictionary."""
    found = df.where(F.col(value).isNotNull()).groupBy((scope[0] if scope else F.lit(0)).cast("long").alias("scope"), F.col(value).alias("value")).agg(F.min(pos).alias("first"))
    found = found.withColumn("stride", F.floor(F.col("first") / STRIDE))
    counts = found.groupBy("scope", "stride").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("scope").orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("scope", "stride").orderBy("first")) - 1
    offsets = counts.select("scope", "stride", before.alias("before"))
    return found.withColumn("own", own).join(offsets, ["scope", "stride"]).select("scope", (F.col("before") + F.col("own")).cast("long").alias("idx"), "value", "first")


def encode(df: DataFrame, value: str, pos: str, scope: list[Column] | None = None) -> DataFrame:
    """(pos, scope, idx): codes; null stays null. The dictionary side is broadcast only if Spark measures it small."""
    scoped = df.select(F.col(pos).alias("pos"), (scope[0] if scope else F.lit(0)).cast("long").alias("scope"), F.col(value).alias("value"))
    return scoped.join(build(df, value, pos, scope).drop("first"), ["scope", "value"], "left").select("pos", "scope", "idx")


def decode(codes: DataFrame, entries: DataFrame) -> DataFrame:
    """(pos, value): a left join, so that a null code is a null value."""
    return codes.join(entries.select("scope", "idx", "value"), ["scope", "idx"], "left").select("pos", "value")


def sizes(df: DataFrame, value: str, pos: str, scope: list[Column] | None = None) -> DataFrame:
    """(scope, n, entries, dict_size, index_size): bytes of a scope's values stored once, and of its codes."""
    kind: T.DataType = df.schema[value].dataType
    key = (scope[0] if scope else F.lit(0)).cast("long").alias("scope")
    per = df.groupBy(key, F.col(value).alias("value")).agg(F.count("*").alias("m"))
    out = per.groupBy("scope").agg(F.sum("m").alias("n"), F.count("value").alias("entries"), F.sum(value_bytes(F.col("value"), kind)).alias("dict_size"))
    return out.withColumn("index_size", F.col("n") * index_bytes(F.col("entries")))


def total(df: DataFrame, value: str, pos: str, scope: list[Column] | None = None) -> DataFrame:
    """(dict_size, index_size) over all scopes: what a strategy costs a column."""
    return sizes(df, value, pos, scope).agg(F.sum("dict_size").alias("dict_size"), F.sum("index_size").alias("index_size"))


def strategies(pos: str, unit: int, fixed: int) -> dict[str, list[Column] | None]:
    """Scopes by name: one dictionary per encoding unit, per some units, and per column."""
    return {"local": [F.floor(F.col(pos) / unit)], "fixed": [F.floor(F.floor(F.col(pos) / unit) / -(-fixed // unit))], "global": None}


def plain(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.sum(value_bytes(F.col(value), df.schema[value].dataType)).alias("plain_size"))


def choose(local: Column, global_: Column) -> Column:
    """The smaller of two costs; ties go to local dictionaries."""
    return F.when(local <= global_, "local").otherwise("global")


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the rank of each row by ``order`` (different non-negative integers, not far apart), from 0: numbered
    in strides whose counts are summed up, so no task numbers them all."""
    df = df.withColumn("__stride", F.floor(F.col(order) / STRIDE))
    counts = df.groupBy("__stride").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__stride").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each stride
    own = F.row_number().over(Window.partitionBy("__stride").orderBy(order)) - 1
    found = df.withColumn("__own", own).join(counts.select("__stride", before.alias("__before")), "__stride")
    return found.withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__stride", "__own", "__before")


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, idx, value, common): two dictionaries that share entries. Common values come first, in b's order; then
    each one's own remainder in its own order."""
    common = a.join(b, "value").select("value", b["idx"].alias("place"))
    n = common.agg(F.count("*").alias("n_common"))
    first = ranked(common, "place", "r").select(F.col("r").alias("idx"), "value")
    out = None
    for name, own in (("a", a), ("b", b)):
        rest = ranked(own.join(common.select("value"), "value", "left_anti"), "idx", "r").select("r", "value")
        rest = rest.crossJoin(F.broadcast(n)).select((F.col("r") + F.col("n_common")).alias("idx"), "value", F.lit(False).alias("common"))  # n is one row
        side = first.withColumn("common", F.lit(True)).unionByName(rest).withColumn("side", F.lit(name))
        out = side if out is None else out.unionByName(side)
    return out.select("side", "idx", "value", "common")


def flushed(dictionaries: DataFrame, value_size: int) -> DataFrame:
    """(dict_id, chunk, n, size): the chunks of a merged pair in the order they are written: common, then each remainder;
    empty ones are not written."""
    chunk = F.when(F.col("common"), 0).when(F.col("side") == "a", 1).otherwise(2)
    sizes = dictionaries.where("not common or side = 'a'").groupBy(chunk.alias("place")).agg(F.count("*").alias("n"))
    placed = sizes.withColumn("dict_id", F.row_number().over(Window.orderBy("place")).cast("long") - 1)  # three rows at most
    name = F.element_at(F.array(F.lit("common"), F.lit("a"), F.lit("b")), F.col("place") + 1)
    return placed.select("dict_id", name.alias("chunk"), "n", (F.col("n") * value_size).alias("size"))


def references(chunks: DataFrame) -> DataFrame:
    """(side, chunks): the chunks that each side's dictionary is made of, the common one first."""
    sides = chunks.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"), "dict_id", "chunk").where("chunk = 'common' or chunk = side")
    return sides.groupBy("side").agg(F.sort_array(F.collect_list("dict_id")).alias("chunks"))


def extended(entries: DataFrame, df: DataFrame, value: str, pos: str) -> tuple[DataFrame, DataFrame]:
    """A dictionary (idx, value) and more rows: the dictionary with the new values after its own, by first occurrence,
    and the codes (pos, idx) of these rows alone. Earlier rows aren't read again."""
    rows = df.select(F.col(pos).alias("pos"), F.col(value).alias("value"))
    fresh = build(df.join(entries.select(F.col("value").alias(value)), value, "left_anti"), value, pos)
    n = entries.agg(F.count("*").alias("n"))
    after = fresh.crossJoin(F.broadcast(n)).select((F.col("idx") + F.col("n")).alias("idx"), "value")  # n is one row
    all_entries = entries.select("idx", "value").unionByName(after)
    return all_entries, rows.join(all_entries, "value", "left").select("pos", "idx")
