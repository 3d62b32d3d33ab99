"""Mixing sources to target weights by a low-discrepancy schedule.

Sources, by code point and null last, weigh 5, 2, 1, repeating, and share the words of the corpus; a target stops at
three times its source, and the excess is shared again by weight (the water level is found by prefix sums over the
sources). A source's documents are shuffled by hash and cut into blocks of equal words. Slot j of the schedule is the
j-th golden-ratio point, mapped through the cumulative slots of the sources to a source; its rank among the slots of
that source names the block (round and round, three passes at most). Ranks and offsets come from counts per chunk and
bucket, so no task holds a source.

Integers decide everything after the targets, and hashes of ids and contents order the documents, not where their rows
lie, so reruns agree. Defined results: a null or empty text has no words; a document or source without words is taken
0 times; a null source is one source more, a null id one id more; repeated rows are documents of their own, equal ones
in any order; an empty table gives an empty one; extra columns play no part in ``mixed`` and stay in ``drawn_texts``,
whatever their names. A text of any length is one document, cut where a block ends.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, written

WEIGHTS = (5, 2, 1)
PASSES = 3
WORDS = r"[^\x20\x09-\x0D]+"
GOLDEN = 2654435769  # 2**32 / golden ratio, odd
CHUNK = 1 << 16  # slots that are ranked together
MEAN_BUCKET = 50_000  # documents of the largest source that are ordered together; buckets are 512 at least
MOST_SLOTS = 1 << 26
BROADCAST_SOURCES = 100_000


def sized(docs: DataFrame, text: str = "text", source: str = "source", rid: str | None = None, content: str | None = None) -> DataFrame:
    """Per row: rid, doc_id, source, size, content; written, so that texts are read once.

    ``content`` names a column that tells rows of one doc_id apart; else their texts do.
    """
    own = F.monotonically_increasing_id() if rid is None else F.col(rid)
    told = F.xxhash64(text) if content is None else F.col(content)
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORDS)).cast("long")
    return written(docs.select(own.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"), told.alias("content")), "sized")


def targets(rows: DataFrame, block_words: int = 1024) -> DataFrame:
    """One row per source: k (its place), source, source_size, target, block (words), n_blocks, n_slots."""
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy()
    by = by.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int") - 1)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("k", F.lit(len(WEIGHTS))) + 1).cast("long")).withColumn("cap", PASSES * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "k")
    by = by.withColumn("total", F.sum("source_size").over(everything))
    by = by.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    by = by.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))).over(everything))
    by = by.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")))
    most = F.greatest(F.lit(block_words), F.ceil(F.col("total") / MOST_SLOTS))
    by = by.withColumn("block", F.greatest(F.lit(1), F.least(most, F.expr("source_size div 256"))).cast("long"))
    by = by.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("n_blocks") / F.col("source_size"))).otherwise(0).cast("long")
    return written(by.select("k", "source", "source_size", "n_docs", "target", "block", "n_blocks", F.least(slots, PASSES * F.col("n_blocks")).alias("n_slots")).coalesce(1), "targets")


def schedule(goal: DataFrame) -> DataFrame:
    """One row per slot of the mix: slot, k, rank, pass, block."""
    spark = goal.sparkSession
    ends = goal.withColumn("hi", F.sum("n_slots").over(Window.orderBy("k"))).select("k", "n_blocks", "hi", (F.col("hi") - F.col("n_slots")).alias("lo")).where("hi > lo")
    n = goal.agg(F.sum("n_slots")).first()[0] or 0
    cells = 4096
    slot = spark.range(n).withColumnRenamed("id", "slot")
    point = F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(1 << 32)) * F.lit(n)
    slot = slot.withColumn("x", F.shiftright(point, 32)).withColumn("cell", F.expr(f"x * {cells} div {max(n, 1)}"))
    reach = ends.withColumn("cell", F.explode(F.sequence(F.expr(f"lo * {cells} div {max(n, 1)}"), F.expr(f"(hi - 1) * {cells} div {max(n, 1)}"))))
    small = F.broadcast(reach) if goal.count() <= BROADCAST_SOURCES else reach  # cells + sources rows at most
    drawn = slot.join(small, "cell").where("x >= lo and x < hi").select("slot", "k", "n_blocks", F.shiftright("slot", 16).alias("chunk"))
    counts = drawn.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = drawn.withColumn("own", F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1).join(counts.select("k", "chunk", before.alias("before")), ["k", "chunk"])
    ranked = ranked.withColumn("rank", (F.col("before") + F.col("own")).cast("long")).where(F.col("rank") < PASSES * F.col("n_blocks"))
    return ranked.select("slot", "k", "rank", F.expr("rank div n_blocks").alias("pass"), F.expr("rank % n_blocks").alias("block"))


def _with(rows: DataFrame, goal: DataFrame, *names: str) -> DataFrame:
    """Rows with columns of their source; null meets null."""

    def key(c: Column) -> list[Column]:
        return [F.coalesce(c, F.lit("")).alias("s"), c.isNull().alias("none")]

    side = goal.select(*key(F.col("source")), *names)
    side = F.broadcast(side) if goal.count() <= BROADCAST_SOURCES else side
    return rows.select("*", *key(F.col("source"))).join(side, ["s", "none"]).drop("s", "none")


def block_pieces(rows: DataFrame, goal: DataFrame, seed: int = 7) -> DataFrame:
    """rid, k, block, words: how a source's shuffled documents fill its blocks, one row for each part of a document."""
    here = _with(rows.where("size > 0"), goal, "k", F.col("block").alias("block_words"))
    most = goal.agg(F.max("n_docs")).first()[0] or 0
    bits = max(9, math.ceil(math.log2(max(1, most) / MEAN_BUCKET)))  # the order is that of h, whatever the buckets
    here = here.withColumn("h", F.xxhash64("doc_id", "content", F.lit(seed))).withColumn("b", F.shiftrightunsigned("h", 64 - bits))
    sums = here.groupBy("k", "b").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum("size").over(Window.partitionBy("k", "b").orderBy("h", "doc_id", "content", "rid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    here = here.withColumn("own", own).join(sums.select("k", "b", before.alias("before")), ["k", "b"]).withColumn("at", F.col("own") + F.col("before"))
    here = here.withColumn("block", F.explode(F.sequence(F.expr("at div block_words"), F.expr("(at + size - 1) div block_words"))))
    words = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("block_words")) - F.greatest("at", F.col("block") * F.col("block_words"))
    return here.select("rid", "k", "block", words.alias("words"))


def mixed(docs: DataFrame, block_words: int = 1024, text: str = "text", source: str = "source", rid: str | None = None, content: str | None = None) -> DataFrame:
    """Per row: rid (the column of that name, or a number of our own), doc_id, size, source_size, target, taken."""
    rows = sized(docs, text, source, rid, content)
    goal = targets(rows, block_words)
    uses = schedule(goal).groupBy("k", "block").agg(F.count("*").alias("uses"))
    taken = block_pieces(rows, goal).join(uses, ["k", "block"]).groupBy("rid").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    out = _with(rows, goal, "source_size", "target").join(taken, "rid", "left")
    return out.select("rid", "doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))


def drawn_texts(docs: DataFrame, block_words: int = 1024) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a document taken q times its size and r words is q whole copies
    and one of its first r words (a block border cuts a document once at most)."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: own[i] for i, c in enumerate(docs.columns)}
    keyed = written(docs.toDF(*own).withColumn("__rid", F.monotonically_increasing_id()), "rows")
    doc_id = F.col(place["doc_id"]) if "doc_id" in place else F.lit(None)
    told = [c for c, t in keyed.drop("__rid").dtypes if "map<" not in t and "variant" not in t]  # what has a hash
    view = keyed.select("__rid", doc_id.alias("doc_id"), F.col(place["text"]).alias("text"), F.col(place["source"]).alias("source"), F.xxhash64(*told).alias("content"))
    plan = mixed(view, block_words, rid="__rid", content="content")
    plan = plan.where("taken > 0").select(F.col("rid").alias("__rid"), F.expr("cast(taken div size as int)").alias("__whole"), F.expr("taken % size").alias("__rest"))
    both = keyed.join(plan, "__rid").drop("__rid")
    text, chars = place["text"], place.get("n_chars")

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        for batch in batches:
            for part in pieces(batch, text):
                whole, rest, texts = (part.column(c).to_pylist() for c in ("__whole", "__rest", text))
                rows, new = [], []
                for i, (q, r) in enumerate(zip(whole, rest, strict=True)):
                    rows += [i] * q
                    new += [texts[i]] * q
                    if r:
                        for n, m in enumerate(word.finditer(texts[i]), 1):
                            if n == r:
                                rows.append(i)
                                new.append(texts[i][: m.end()])
                                break
                out = part.drop_columns(["__whole", "__rest"]).take(pa.array(rows, pa.int64()))
                at = out.schema.get_field_index(text)
                out = out.set_column(at, out.schema.field(at), pa.array(new, out.schema.field(at).type))
                if chars and pa.types.is_integer(out.schema.field(chars).type):
                    at = out.schema.get_field_index(chars)
                    out = out.set_column(at, out.schema.field(at), pa.array([len(x) for x in new], out.schema.field(at).type))
                yield out

    return both.mapInArrow(copies, both.drop("__whole", "__rest").schema).toDF(*docs.columns)
