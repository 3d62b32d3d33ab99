"""What the training-data operators share: tables in the shared folder, word hashing over Arrow buffers, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, written

NO_ID = -(2**63)  # stands for a null document id: smaller than every other id


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_or_least(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def text_bytes(df: DataFrame, name: str = "text") -> int:
    """Bytes of all texts: one scan in the JVM."""
    return df.agg(F.sum(F.octet_length(name))).first()[0] or 0


# -- words over Arrow buffers -------------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit flips each output bit about half the time."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
STEP = 2 << 20  # bytes of text that are hashed at a time: temporary arrays take some 60 times as much


def _up_to(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _up_to(1 << 12)


def powers(n: int) -> np.ndarray:
    """The first ``n`` or more powers of an odd base modulo 2**64."""
    return _POWERS if n <= len(_POWERS) else _up_to(n)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; null counts as empty."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(array) else np.zeros(0, np.uint8)
    return offsets - offsets[0] if len(array) else np.zeros(1, np.int64), data


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, one row at least: what Python holds at a time doesn't follow the batch."""
    offsets, _ = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def word_hashes(offsets: np.ndarray, data: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated texts: start, end, row of the text, 64-bit hash.

    Long texts are hashed in parts of ``STEP`` bytes that end at a white space or at a text's end.
    """
    found, at = [], 0
    while at < len(data) or not found:
        end = at + STEP
        if end < len(data):
            text_end = int(offsets[np.searchsorted(offsets, end)])
            for a in range(end, text_end, STEP):
                blank = SPACE[data[a : min(a + STEP, text_end)]]
                if blank.any():
                    text_end = a + int(blank.argmax())
                    break
            end = text_end
        end = min(end, len(data))
        inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end)]
        starts, ends, h = _words(np.r_[at, inner, end] - at, data[at:end], lower)
        found.append((starts + at, ends + at, h))
        at = end
    starts, ends, h = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found, strict=True))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1, h


def _words(offsets: np.ndarray, data: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    none = np.zeros(0, np.int64)
    solid = ~SPACE[data]
    if not solid.any():
        return none, none, np.zeros(0, np.uint64)
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    head[first] = solid[first]
    tail = solid.copy()
    tail[:-1] &= ~solid[1:] | head[1:]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    lens = ends - starts
    at = np.cumsum(lens) - lens
    chars = data[solid]
    if lower:
        chars = LOWER[chars]
    place = np.arange(len(chars)) - np.repeat(at, lens)
    h = np.add.reduceat(_BYTE[chars] * powers(int(lens.max()))[place], at)
    return starts, ends, mix(h + lens.astype(np.uint64))


def windows(rows: np.ndarray, h: np.ndarray, k: int, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``k`` consecutive words of one row: index of the first word, hash."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - k + 1
    own = np.flatnonzero(rows[:n] == rows[k - 1 :])
    value = np.zeros(n, np.uint64)
    for j in range(k):
        value = value * base + h[j : j + n]
    return own, mix(value[own])


def packed(values: np.ndarray, kind: str = "<u8") -> bytes:
    """Integers with their bytes transposed and compressed: equal high bytes cost almost nothing."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes(), 1)


def unpacked(blob: bytes, kind: str = "<u8") -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


# -- joins on keys that many rows have -----------------------------------------------------------------------------

HOT_ROWS = 1000  # rows of a key that one task is given, at least
FEW_ROWS = 10_000  # rows of all keys that one task may be given
MOST_HOT = 10_000  # keys that are broadcast, at most


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], n: str, total: int, salt: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key (none null) and in ``n`` how many rows of ``left`` have it.

    ``total`` is the sum of ``n`` or more. A key with more than ``limit`` rows is dealt by ``salt``, a column of
    ``left``, to as many tasks as it needs, however AQE is set. At most ``MOST_HOT`` keys can have so many: they are
    broadcast. Where all rows together are what a task may be given, it is a plain join.
    """
    if total <= FEW_ROWS:
        return left.join(right.drop(n), list(keys), how)
    limit = max(HOT_ROWS, total // MOST_HOT)
    parts = F.expr(f"cast(if({n} > {limit}, {n} div {limit} + 1, 1) as int)")
    hot = F.broadcast(right.where(F.col(n) > limit).select(*keys, parts.alias("__parts")))
    dealt = left.join(hot, list(keys), "left").withColumn("__salt", F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(salt), F.col("__parts")))).drop("__parts")
    copied = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return dealt.withColumn("__salt", F.col("__salt").cast("int")).join(copied, [*keys, "__salt"], how).drop("__salt")


# -- rows by a filter of ids ---------------------------------------------------------------------------------------

MAX_BITS = 1 << 28  # 32 MB


def marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` (id, ...) with ``__may``: false only where the id is not among ``ids`` (id).

    A Bloom filter of one hash, broadcast, 4 KB for each 32768 bits: some 32 bits an id, ``MAX_BITS`` in all. Past
    that size more others are true, so callers join with ``ids`` afterwards.
    """
    bits = int(min(MAX_BITS, max(1 << 15, 1 << (32 * ids.count()).bit_length())))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    cell = F.expr(f"pmod(xxhash64(id), {bits}L) div 32768").alias("__cell")
    cells = ids.select(cell, (place % 32768).alias("bit")).groupBy("__cell").agg(F.bitmap_construct_agg("bit").alias("__bits"))
    placed = docs.withColumns({"__cell": cell, "__bit": (place % 32768).cast("int")})
    byte = F.expr("cast(conv(hex(substring(__bits, __bit div 8 + 1, 1)), 16, 10) as int)")
    held = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, __bit % 8)")) != 0, F.lit(False))
    return placed.join(F.broadcast(cells), "__cell", "left").withColumn("__may", held).drop("__cell", "__bit", "__bits")


def likely(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` (id, ...) that ``marked`` lets through: all with an id of ``ids``, and few others."""
    return marked(docs, ids).where("__may").drop("__may")


# -- rows in compressed blocks -------------------------------------------------------------------------------------

BLOCK = 16 << 20  # bytes of text of a block


def blocks_for(spark: SparkSession, n_bytes: int) -> int:
    return max(partitions(spark), n_bytes // BLOCK)


def blocked(df: DataFrame, by: Column, n: int, text: str = "text") -> DataFrame:
    """(block, rows): the rows of ``df`` in ``n`` blocks by the number ``by``, some megabytes of a task's rows compressed
    together: texts that must move take less than half of what they take one by one. ``unblocked`` is the way back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                rows = pa.Table.from_batches(held).combine_chunks()
                held.clear()
                to = rows.column("__block").to_numpy()
                order = np.argsort(to, kind="stable")
                cut = np.flatnonzero(np.r_[True, np.diff(to[order]) != 0, True])
                rows = rows.drop_columns(["__block"])
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    some, sink = rows.take(pa.array(order[a:b])), pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_table(some)
                    yield pa.RecordBatch.from_arrays([pa.array([int(to[order[a]])], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

        for batch in batches:
            for part in pieces(batch, text):
                held.append(part)
                if (size := size + part.nbytes) >= BLOCK:
                    yield from flush()
                    size = 0
        yield from flush()

    return df.withColumn("__block", F.pmod(by, F.lit(n)).cast("long")).mapInArrow(run, "block long, rows binary")


def unblocked(blobs: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    for blob in blobs:
        yield from pa.ipc.open_stream(blob.as_buffer())


# -- connected components -----------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (a, b): the smallest id reachable.

    Alternating large-star and small-star steps; each step is a minimum with map-side combine and a join that deals a
    hub's links to many tasks. Every round is written to the shared folder, and the one before it deleted. Nothing but
    two sums for the stop test reaches the driver.
    """

    def stars(e: DataFrame, n: int) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = hot_join(both, least, ["u"], "n", 2 * n, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        kept = hot_join(large, small, ["u"], "n", 2 * n, "v").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return kept.unionAll(small.select("u", "m")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", few=True)
    seen = state(now)
    while seen[0]:
        before, now = now, written(stars(now, seen[0]), "stars", few=True)
        found = state(now)
        discard(before)
        if found == seen:
            break
        seen = found
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
