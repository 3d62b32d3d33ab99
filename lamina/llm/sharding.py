"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard; at each level it takes the child with the smallest draw. A shard draws
``-ln(u) / weight``, u hashed from the row's key and the shard's name; the draw of a rack or region is the smallest of
the shards below it. The smallest of exponential draws is itself one, at the sum of their weights: so each level is a
weighted draw among its children, and the draws of the levels agree. That is what confines movement: a weight that
grows only wins rows for its own shard, one that shrinks only loses them, and nothing else moves within any subtree. So
a further shard, wherever it hangs, takes rows only into itself, for every count (law ``key``). The price is one hash
per shard and row.

Everything is one expression over built-in functions. Slots are numbered from counts per shard and bucket, so no task
holds a shard. Defined results: a null text is empty (size 1); a null id is one more key; rows that repeat an id share a
shard and have slots of their own, equal rows in any order; an empty table gives an empty one; extra columns play no
part; texts of any length are only measured and summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tree = dict[str, "float | Tree"]  # name -> subtree, or a shard's weight; shards are named by their number

BUCKETS = 4096  # for slots; 16 shards * 4096 offsets are broadcast


def tree(shards: int) -> Tree:
    """Racks of 4 equal shards, regions of 2 racks: a shard's place doesn't depend on how many there are."""
    out: Tree = {}
    for s in range(shards):
        out.setdefault(f"region{s // 8}", {}).setdefault(f"rack{s // 4}", {})[str(s)] = 1.0
    return out


def leaves(node: Tree, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], float]]:
    """Every shard of positive weight: its path from the root, its own name last, and its weight."""
    out = []
    for name, child in node.items():
        out += leaves(child, (*path, name)) if isinstance(child, dict) else [((*path, name), float(child))] if child > 0 else []
    return out


def draw(key: Column, path: tuple[str, ...], weight: float) -> Column:
    """The draw of the shard at ``path``, with the names to descend by; of equal draws the smaller name's counts."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path[-1])), 11).cast("double") + 0.5) / float(2**53)
    return F.struct((-F.log(u) / weight).alias("t"), F.array(*map(F.lit, path)).alias("path"))


def smallest(key: Column, node: Tree) -> Column:
    """The smallest draw below ``node`` (t, path): the child that wins at each level is on its path."""
    return F.array_min(F.array(*(draw(key, path, weight) for path, weight in leaves(node))))


def place(key: Column, node: Tree) -> Column:
    """The shard that ``key`` descends to."""
    return F.element_at(smallest(key, node)["path"], -1).cast("int")


def sharded(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more), region, rack per row."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    path, weight = next(x for x in leaves(tree(shards + 1)) if x[0][-1] == str(shards))
    found = rows.withColumns({"won": smallest(F.col("doc_id"), tree(shards)), "b": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(BUCKETS)).cast("int")})
    found = found.withColumn("grown", F.array_min(F.array("won", draw(F.col("doc_id"), path, weight))))
    names = {"region": F.get("won.path", 0), "rack": F.get("won.path", 1), "shard": F.get("won.path", 2).cast("int"), "grown_shard": F.get("grown.path", 2).cast("int")}
    found = found.withColumns(names).drop("won", "grown")
    counts = found.groupBy("shard", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "b", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "size", "text_crc32")) - 1
    small = F.broadcast(offsets) if shards * BUCKETS <= 1 << 17 else offsets
    out = found.withColumn("own", own).join(small, ["shard", "b"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), "grown_shard", "region", "rack")
