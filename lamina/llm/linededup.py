"""Line dedup across a corpus: two Bloom filters find suspects, and only suspects shuffle for the exact decision.

1. Each task hashes the line keys of its texts. Keys it saw in one document set bits of the *once* filter, keys it saw
   in two set bits of the *twice* filter. What moves are bit positions, by filter segment.
2. A segment's owner merges the tasks: a bit that two tasks set *once* is set *twice*. A key in two documents so has
   all its bits in *twice*; other keys may have them by chance.
3. The merged *twice* filter is broadcast; its size is bounded by ``MAX_BITS``, whatever the corpus. Beyond the size
   that the corpus would need, more keys pass by chance and shuffle; the result is the same.
4. Suspects shuffle as (128-bit key, document): documents per key and the document that keeps its lines are exact.
5. Documents that may lose a line, by a filter of ids, meet the keys that they lose, texts in compressed blocks; others
   don't shuffle.

Defined results: a null or empty text is one empty line. Rows with a null id and one text are one document, below all
that have an id; the text's hash stands for the id, so they don't meet under one key. Rows that repeat an id are one
document for the counts; each row is treated and returned. Of equal ids no line is dropped for the other's sake. Keys
shorter than ``min_chars`` are never dropped. An empty table gives an empty one. Extra columns stay, whatever their
names. Long texts are split whole, in some 10 times their size.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import blocked, blocks_for, discard, hot_join, marked, mix, partitions, pieces, text_bytes, unblocked, written

MAX_BITS = 1 << 28  # 32 MB for a filter
SEGMENTS = 256
HASHES = 2
SPACES = b"\t\n\x0b\x0c\r "


def document() -> Column:
    """A number that equal documents share; a text's stands for a null id, and may meet another's id."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The 128-bit key of each line, None for one shorter than ``min_chars``."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACES).lower()  # of bytes: A-Z only
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """Filter positions of 64-bit halves of keys: one row per key."""
    return np.stack([mix(keys + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(bits) for i in range(HASHES)], axis=1).astype(np.int64)


def filter_bits(n_bytes: int) -> int:
    """A power of two: some 16 bits for each line of 100 bytes, within 2**16 and MAX_BITS."""
    return int(min(MAX_BITS, max(1 << 16, 1 << max(0, int(n_bytes * 16 // 100) - 1).bit_length())))


def twice_filter(docs: DataFrame, min_chars: int, bits: int) -> np.ndarray:
    """The merged filter of keys seen in two documents or more, as packed bits."""
    per = bits // SEGMENTS

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            pairs = np.unique(np.stack([np.concatenate(keys), np.concatenate(ids).astype(np.int64).view(np.uint64)], axis=1), axis=0)
            key, count = np.unique(pairs[:, 0], return_counts=True)
            rows = {"segment": [], "once": [], "twice": []}
            places = [np.unique(positions(x, bits)) for x in (key, key[count > 1])]
            cut = [np.searchsorted(p, np.arange(SEGMENTS + 1) * per) for p in places]
            for s in range(SEGMENTS):
                once, twice = ((p[c[s] : c[s + 1]] - s * per).astype("<u4") for p, c in zip(places, cut, strict=True))
                if len(once):
                    rows["segment"].append(s), rows["once"].append(once.tobytes()), rows["twice"].append(twice.tobytes())
            keys.clear(), ids.clear()
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())]))

        for batch in batches:
            for part in pieces(batch):
                for doc, text in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if own := {k for k in line_keys(text, min_chars) if k}:
                        keys.append(np.frombuffer(b"".join(own), "<u8")[::2])
                        ids.append(np.full(len(own), doc))
                        size += len(own)
            if size > 2_000_000:
                yield from flush()
                size = 0
        yield from flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict = defaultdict(lambda: np.zeros(per, bool))
        twice: dict = defaultdict(lambda: np.zeros(per, bool))
        for batch in batches:
            for s, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = np.frombuffer(a, "<u4")
                twice[s][at[once[s][at]]] = True
                twice[s][np.frombuffer(b, "<u4")] = True
                once[s][at] = True
        if twice:
            found = [(s, np.packbits(x).tobytes()) for s, x in twice.items() if x.any()]
            yield pa.RecordBatch.from_pydict({"segment": [s for s, _ in found], "bits": [b for _, b in found]}, pa.schema([("segment", pa.int32()), ("bits", pa.binary())]))

    n = min(SEGMENTS, partitions(docs.sparkSession))
    parts = docs.select(document().alias("id"), F.col("text")).mapInArrow(seen, "segment int, once binary, twice binary")
    rows = parts.repartition(n, "segment").mapInArrow(merged, "segment int, bits binary").collect()  # SEGMENTS rows, bits / 8 bytes in all
    out = np.zeros(bits // 8, np.uint8)
    for s, x in rows:
        out[s * per // 8 : (s + 1) * per // 8] = np.frombuffer(bytes(x), np.uint8)
    return out


def dropped_keys(docs: DataFrame, min_chars: int, min_docs: int, bits: int) -> DataFrame:
    """Written: (named, id, keys), for each document that loses lines (``named``: 0 where ``id`` stands for a null) its lost keys."""
    twice = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, min_chars, bits))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = twice.value
        kinds = pa.schema([("key", pa.binary()), ("named", pa.int32()), ("id", pa.int64())])
        for batch in batches:
            for part in pieces(batch):
                keys, rows = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    own = {k for k in line_keys(text, min_chars) if k}
                    keys += own
                    rows += [i] * len(own)
                if keys:
                    at = positions(np.frombuffer(b"".join(keys), "<u8")[::2], bits)
                    hit = np.flatnonzero(((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1))
                    of = pa.array([rows[i] for i in hit], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit], pa.binary()), part.column("named").take(of), part.column("id").take(of)], schema=kinds)

    here = docs.select(F.col("doc_id").isNotNull().cast("int").alias("named"), document().alias("id"), F.col("text"))
    found = written(here.mapInArrow(suspects, "key binary, named int, id long").distinct(), "suspects", few=True)
    common = written(found.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("named", "id")).alias("keeper")).where(F.col("n") >= min_docs), "common", few=True)
    lost = hot_join(found, common, ["key"], "n", found.count(), "id").where("struct(named, id) <> keeper")
    out = written(lost.groupBy("named", "id").agg(F.collect_set("key").alias("keys")), "lost", few=True)
    discard(found, common)
    twice.unpersist()
    return out


def apply_lines(docs: DataFrame, lost: DataFrame, min_chars: int, digest: bool, n: int) -> DataFrame:
    """The rows of ``docs`` without the lines in ``lost``, by way of ``n`` blocks: texts as they stay, or their counts and digests."""
    own = [f"c{i}" for i in range(len(docs.columns))]  # clashing names can't meet here
    place = {c: own[i] for i, c in enumerate(docs.columns)}
    text = place["text"]
    here = docs.withColumns({"__named": F.col("doc_id").isNotNull().cast("int"), "__id": document()}).toDF(*own, "named", "id")
    if digest:
        here = here.select(F.col(place["doc_id"]).cast("long").alias("doc_id"), F.col(text).alias("text"), "named", "id")
        text = "text"
    here = marked(here, lost.select("id"))
    same, may = here.where("not __may").drop("named", "id", "__may"), here.where("__may").drop("__may")
    schema = T.StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept_sha256 string") if digest else same.schema

    def treated(part: pa.RecordBatch, lose: dict | None) -> pa.RecordBatch:
        texts, n_lines, gone = part.column(text).to_pylist(), [], []
        ids = zip(part.column("named").to_pylist(), part.column("id").to_pylist(), strict=True) if lose is not None else None
        for i in range(part.num_rows):
            drop, kept = lose.get(next(ids)) if ids else None, None
            if digest:
                n_lines.append(texts[i].count("\n") + 1 if texts[i] else 1)
            if drop:
                kept = [x for x, k in zip((texts[i] or "").split("\n"), line_keys(texts[i], min_chars), strict=True) if k not in drop]
                texts[i] = "\n".join(kept)
            if digest:
                gone.append(n_lines[-1] - len(kept) if kept is not None else 0)
        if digest:
            sha = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])
        at = part.schema.get_field_index(text)
        part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
        return part.drop_columns(["named", "id"]) if lose is not None else part

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                yield treated(part, None)

    def together(left: pa.Table, right: pa.Table) -> pa.Table:
        lose = {(a, b): set(k) for a, b, k in zip(*(right.column(c).to_pylist() for c in ("named", "id", "keys")), strict=True)}
        found = [treated(part, lose) for batch in unblocked(left.column("rows")) for part in pieces(batch, text)]
        return pa.Table.from_batches(found) if found else pa.Table.from_batches([], arrow)

    arrow = to_arrow_schema(schema)
    by = F.xxhash64("named", "id")
    met = blocked(may, by, n, text).groupBy("block").cogroup(lost.withColumn("block", F.pmod(by, F.lit(n)).cast("long")).groupBy("block")).applyInArrow(together, schema)
    done = met.unionAll(same.mapInArrow(alone, schema))
    return done if digest else done.toDF(*docs.columns)


def treat(docs: DataFrame, min_chars: int, min_docs: int, bits: int | None, digest: bool) -> DataFrame:
    n_bytes = text_bytes(docs)
    lost = dropped_keys(docs, min_chars, min_docs, bits or filter_bits(n_bytes))
    return apply_lines(docs, lost, min_chars, digest, blocks_for(docs.sparkSession, n_bytes))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int | None = None) -> DataFrame:
    """``docs`` with the texts that stay; all other columns as they are."""
    return treat(docs, min_chars, min_docs, bits, digest=False)


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row."""
    return treat(docs, min_chars, min_docs, bits, digest=True)
