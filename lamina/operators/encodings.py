"""Light-weight encodings over explicit positions: what each would store, its size, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import bit_width, index_bytes, packed_bytes

MINI = 1024  # values of a bit-packed block
WINDOW = 128  # values of a window-dictionary entry
MOST_WINDOWS = 255


def bit_widths(df: DataFrame, value: str, pos: str, block: int = MINI) -> DataFrame:
    """(block_id, n, width, bytes) per mini-block, by its largest value."""
    return df.groupBy(F.floor(F.col(pos) / block).cast("long").alias("block_id")).agg(F.count(value).alias("n"), bit_width(F.max(value)).alias("width")).withColumn("bytes", packed_bytes(F.col("n"), F.col("width")))


def framed(df: DataFrame, value: str, pos: str, unit: int) -> DataFrame:
    """Frame of reference: (unit_id, n, base, width, bytes)."""
    out = df.groupBy(F.floor(F.col(pos) / unit).cast("long").alias("unit_id")).agg(F.count(value).alias("n"), F.min(value).alias("base"), bit_width(F.max(value) - F.min(value)).alias("width"))
    return out.withColumn("bytes", 8 + packed_bytes(F.col("n"), F.col("width")))


def _within(pos: str, unit: int) -> Window:
    return Window.partitionBy(F.floor(F.col(pos) / unit)).orderBy(pos)


def deltas(df: DataFrame, value: str, pos: str, unit: int) -> DataFrame:
    """(pos, delta): differences within a unit; its first value is stored whole."""
    return df.select(F.col(pos).alias("pos"), (F.col(value) - F.coalesce(F.lag(value).over(_within(pos, unit)), F.lit(0))).alias("delta"))


def from_deltas(df: DataFrame, unit: int) -> DataFrame:
    w = _within("pos", unit).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("pos", F.sum("delta").over(w).alias("value"))


def runs(df: DataFrame, value: str, pos: str, unit: int) -> DataFrame:
    """Run-end encoding per unit: (unit_id, run_id, value, run_end, length). Nulls are equal to one another."""
    w = _within(pos, unit)
    new = (F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))
    marked = df.select(F.floor(F.col(pos) / unit).cast("long").alias("unit_id"), F.col(pos).alias("pos"), F.col(value).alias("value"), new.cast("long").alias("new"))
    numbered = marked.withColumn("run_id", F.sum("new").over(Window.partitionBy("unit_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy("unit_id", "run_id", "value").agg((F.max("pos") + 1).alias("run_end"), F.count("*").alias("length"))


def from_runs(run: DataFrame) -> DataFrame:
    """(pos, value): positions are dense within a run."""
    return run.select(F.explode(F.sequence(F.col("run_end") - F.col("length"), F.col("run_end") - 1)).alias("pos"), "value")


def constants(df: DataFrame, value: str, pos: str, unit: int) -> DataFrame:
    """(unit_id, constant): whether a unit has one value and no null."""
    return df.groupBy(F.floor(F.col(pos) / unit).cast("long").alias("unit_id")).agg(F.coalesce((F.min(value) == F.max(value)) & (F.count(value) == F.count("*")), F.lit(False)).alias("constant"))


def cascade(df: DataFrame, value: str, pos: str, unit: int) -> DataFrame:
    """(unit_id, scheme, bytes): the smallest of the models for an integer column, ties by name. One aggregation."""
    w = _within(pos, unit)
    marked = df.select(F.floor(F.col(pos) / unit).cast("long").alias("unit_id"), F.col(value).alias("v"), ((F.row_number().over(w) == 1) | ~F.lag(value).over(w).eqNullSafe(F.col(value))).cast("long").alias("new"))
    s = marked.groupBy("unit_id").agg(F.count("v").alias("n"), F.count("*").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.countDistinct("v").alias("d"), F.sum("new").alias("r"))
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    never = F.lit(2**62)
    models = {
        "bitpacked": F.when(lo >= 0, packed_bytes(n, bit_width(hi))).otherwise(never),
        "constant": F.when((lo == hi) & (n == F.col("all")), F.lit(8)).otherwise(never),
        "dictionary": F.col("d") * 8 + F.col("all") * index_bytes(F.col("d")),
        "for": 8 + packed_bytes(n, bit_width(hi - lo)),
        "plain": n * 8,
        "runend": F.col("r") * 12,
    }
    best = F.array_min(F.array(*(F.struct(F.coalesce(c, never).cast("long").alias("bytes"), F.lit(k).alias("scheme")) for k, c in models.items())))
    return s.select("unit_id", best["scheme"].alias("scheme"), best["bytes"].alias("bytes"))


def alp_exponents(df: DataFrame, value: str, pos: str, unit: int, most: int = 6) -> DataFrame:
    """(unit_id, exponent, matches): per unit the decimal exponent under which most doubles are exact integers."""
    x = F.col(value)
    tries = [F.struct(F.sum((F.rint(x * 10.0**e) / 10.0**e == x).cast("long")).alias("matches"), F.lit(-e).alias("minus")) for e in range(most + 1)]
    best = df.groupBy(F.floor(F.col(pos) / unit).cast("long").alias("unit_id")).agg(F.array_max(F.array(*tries)).alias("b"))
    return best.select("unit_id", (-F.col("b.minus")).cast("long").alias("exponent"), "b.matches")


def date_parts(c: Column) -> list[Column]:
    """Days, seconds in the day and microseconds of a timestamp."""
    us = F.unix_micros(c.cast("timestamp"))
    return [F.floor(us / 86_400_000_000).cast("long").alias("days"), F.floor(F.pmod(us, F.lit(86_400_000_000)) / 1_000_000).cast("long").alias("seconds"), F.pmod(us, F.lit(1_000_000)).alias("micros")]


def window_entries(df: DataFrame, value: str, pos: str, unit: int, width: int = WINDOW) -> DataFrame:
    """Window dictionary per unit: (unit_id, window_id, code, pattern). Whole windows only; a unit of more than
    MOST_WINDOWS patterns is stored plainly (its codes are null)."""
    wide = df.groupBy(F.floor(F.col(pos) / unit).cast("long").alias("unit_id"), F.floor(F.col(pos) / width).cast("long").alias("window_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))), lambda x: x["v"]).alias("pattern"))
    wide = wide.where(F.size("pattern") == width)
    firsts = wide.groupBy("unit_id", "pattern").agg(F.min("window_id").alias("first"))
    ranked = firsts.withColumn("code", F.row_number().over(Window.partitionBy("unit_id").orderBy("first")).cast("long") - 1).withColumn("most", F.count("*").over(Window.partitionBy("unit_id")))
    return wide.join(ranked.select("unit_id", "pattern", F.when(F.col("most") <= MOST_WINDOWS, F.col("code")).alias("code")), ["unit_id", "pattern"]).select("unit_id", "window_id", "code", "pattern")


def from_windows(entries: DataFrame, width: int = WINDOW) -> DataFrame:
    """(pos, value) from codes and the dictionary, or from the pattern itself where a unit is stored plainly."""
    coded = entries.where("code is not null")
    book = coded.groupBy("unit_id", "code").agg(F.first("pattern").alias("pattern"))
    back = coded.drop("pattern").join(book, ["unit_id", "code"]).select("window_id", "pattern").unionAll(entries.where("code is null").select("window_id", "pattern"))
    out = back.select("window_id", F.posexplode("pattern").alias("i", "value"))
    return out.select((F.col("window_id") * width + F.col("i")).alias("pos"), "value")


def list_offsets(df: DataFrame, column: str, pos: str, unit: int) -> DataFrame:
    """(pos, valid, start, stop): validity and offsets of lists, from 0 in each unit; a null list is empty."""
    n = F.coalesce(F.when(F.col(column).isNotNull(), F.size(column)), F.lit(0))
    stop = F.sum("n").over(_within("pos", unit).rowsBetween(Window.unboundedPreceding, 0))
    return df.select(F.col(pos).alias("pos"), F.col(column).isNotNull().alias("valid"), n.cast("long").alias("n")).withColumn("stop", stop).select("pos", "valid", (F.col("stop") - F.col("n")).alias("start"), "stop")


def list_items(df: DataFrame, column: str, pos: str) -> DataFrame:
    """(pos, i, item): the flattened child."""
    return df.select(F.col(pos).alias("pos"), F.posexplode(column).alias("i", "item"))


def to_lists(offsets: DataFrame, items: DataFrame) -> DataFrame:
    """(pos, items): lists from validity and children; null items and empty and null lists come back."""
    held = items.groupBy("pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.struct("item").alias("x")))), lambda y: y["x"]["item"]).alias("items"))
    none = F.when(F.col("valid"), F.col("items")).otherwise(None)
    return offsets.join(held, "pos", "left").select("pos", F.when(F.col("valid") & F.col("items").isNull(), F.expr("slice(array(null), 1, 0)").cast(held.schema["items"].dataType)).otherwise(none).alias("items"))
