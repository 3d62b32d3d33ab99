"""Which dictionaries are alike: exact and sketched Jaccard similarity, the merge rule, and greedy matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rule that decides a merge, and the sketch.
MIN_JACCARD = 0.01
FULL_JACCARD = 0.99
MIN_OVERLAP = 1024
SKETCH_K = 2048
SKETCH_HASHES = 3


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_id, kind, value) with each value once: one pass over the table. Values of two types are never equal."""
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(i).cast("int").alias("column_id"), F.lit(kinds[c]).alias("kind"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    return df.select(F.inline(F.array(*cells))).where("value is not null").distinct()


def pairs(values: DataFrame) -> DataFrame:
    """(i, j, n_i, n_j, overlap, jaccard) of columns that share a value: an equi-join on values. A value gives at most
    one row for each pair of columns, however often it occurs."""
    n = values.groupBy("column_id").agg(F.count("*").alias("n"))
    a, b = (values.select(F.col("column_id").alias(x), "kind", "value") for x in "ij")
    both = a.join(b, ["kind", "value"]).where("i < j").groupBy("i", "j").agg(F.count("*").alias("overlap"))
    out = both.join(n.select(F.col("column_id").alias("i"), F.col("n").alias("n_i")), "i").join(n.select(F.col("column_id").alias("j"), F.col("n").alias("n_j")), "j")
    return out.select("i", "j", "n_i", "n_j", "overlap", F.round(F.col("overlap") / (F.col("n_i") + F.col("n_j") - F.col("overlap")), 6).alias("jaccard"))


def estimated_overlap(n_i: Column, n_j: Column, jaccard: Column) -> Column:
    return (n_i + n_j) * jaccard / (1 + jaccard)


def merges(n_i: Column, n_j: Column, jaccard: Column) -> Column:
    """Similar enough, and either nearly equal or with a large overlap."""
    small = (estimated_overlap(n_i, n_j, jaccard) < MIN_OVERLAP) & (jaccard < FULL_JACCARD)
    return (jaccard >= MIN_JACCARD) & ~small


def matched(edges: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """Greedy matching: by similarity descending, then ids; a dictionary merges once at most. Edges are pairs of
    columns of one table, a few."""
    used: set[int] = set()
    out = []
    for i, j, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if not {i, j} & used:
            used |= {i, j}
            out.append((i, j))
    return out


def hashes(value: Column) -> list[Column]:
    """Independent 52-bit hashes of a value: pieces of a digest that any engine has."""
    return [F.conv(F.substring(F.md5(F.concat(F.lit(f"{m}:"), value)), 1, 13), 16, 10).cast("long") for m in range(SKETCH_HASHES)]


def sketches(values: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(column_id, m, h): the k smallest hashes of a column's values under each hash function. A first cut within
    hashed parts keeps the final ranking to parts * k rows per column."""
    flat = values.select("column_id", F.posexplode(F.array(*hashes(F.col("value")))).alias("m", "h"))
    part = F.pmod(F.col("h"), F.lit(64))
    first = flat.withColumn("r", F.row_number().over(Window.partitionBy("column_id", "m", part).orderBy("h"))).where(F.col("r") <= k)
    return first.withColumn("r", F.row_number().over(Window.partitionBy("column_id", "m").orderBy("h"))).where(F.col("r") <= k).select("column_id", F.col("m").cast("int").alias("m"), "h")


def sketch_jaccard(sketch: DataFrame, i: int, j: int, k: int = SKETCH_K) -> DataFrame:
    """(jaccard): of the k smallest hashes of both columns together, the share that both have; mean over functions."""
    both = sketch.where(F.col("column_id").isin(i, j)).groupBy("m", "h").agg(F.count("*").alias("n"))
    top = both.withColumn("r", F.row_number().over(Window.partitionBy("m").orderBy("h"))).where(F.col("r") <= k)
    return top.groupBy("m").agg(F.avg((F.col("n") == 2).cast("double")).alias("j")).agg(F.round(F.avg("j"), 6).alias("jaccard"))
