"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine, components.

Equal vectors of a label are one class. A class falls into one bucket per table, by the signs of its products with the
table's hyperplanes. Buckets are compared in blocks of bounded size; a pair is counted in the first table that brings
it together, so each link counts once, and a block emits counts and one link per member, never its pairs. The number
of bits follows the largest label; the number of tables follows from the bits so that a pair at the threshold is missed
with probability ``MISS`` at any size.

A class is shuffled once for each table it meets others in: as components of 4 bytes where they hold the vector exactly,
and codes of 1 to 4 bytes. Tasks get some thousand rows of whole blocks at a time.

Only vectors of equal, non-null labels and equal length are compared. Defined results: null, empty, zero vectors and
those with null or non-finite components link with nothing; a null id links with nothing, component_id null, kept;
rows that repeat an id are vectors of their own; equal vectors link, whatever their number; a pair just at the threshold
links if its cosine in doubles reaches it; an empty table gives an empty one. Extra columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, hot_join, written

MISS = 1e-6
MEAN_BUCKET = 128
BLOCK = 512
TOGETHER = 4096  # rows of a table's blocks that are handed to Python at a time


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for labels of up to ``largest`` vectors."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(24, max(3, math.ceil(math.log2(max(1, largest) / MEAN_BUCKET))))
    return bits, math.ceil(math.log(MISS) / math.log(1 - same**bits))


def hyperplanes(dim: int, bits: int, tables: int) -> np.ndarray:
    return np.random.default_rng([20240301, dim]).standard_normal((dim, tables * bits))


def code_kind(bits: int) -> str:
    return "<u1" if bits <= 8 else "<u2" if bits <= 16 else "<u4"


def units(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow on the way."""
    u = values / np.abs(values).max(axis=1, keepdims=True)
    return u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def coded(vectors: DataFrame, bits: int, tables: int) -> DataFrame:
    """vec_id, label, dim, same1, same2 (hash of the vector), vector (bytes), codes; dim null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        place = 1 << np.arange(bits)
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                col = part.column("embedding")
                at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
                held = col.values.slice(0, int(at[-1]))
                flat = held.fill_null(float("nan")).to_numpy(zero_copy_only=False)  # a null is as unusable as a NaN
                size = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
                out: list[list] = [[None] * len(col) for _ in range(5)]
                for d in map(int, np.unique(size[size > 0])):
                    rows = np.flatnonzero(size == d)
                    v = flat[at[rows][:, None] + np.arange(d)]
                    able = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
                    rows, v = rows[able], v[able]
                    if not len(rows):
                        continue
                    if d not in planes:
                        planes[d] = hyperplanes(d, bits, tables)
                    code = ((units(v) @ planes[d] > 0).reshape(len(v), tables, bits) * place).sum(axis=2)
                    with np.errstate(over="ignore"):
                        small = v.astype("<f4")
                    exact = (small == v).all(axis=1)
                    for i, x, y, short, c in zip(rows, v, small, exact, code.tolist(), strict=True):
                        own = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<i8").tolist()
                        for o, f in zip(out, (d, *own, (y if short else x).tobytes(), c), strict=True):
                            o[i] = f
                kinds = pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], ["vec_id", "label", "dim", "same1", "same2", "vector", "codes"])

    here = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return here.mapInArrow(run, "vec_id long, label string, dim int, same1 long, same2 long, vector binary, codes array<int>")


def unpacked(vectors: list[bytes], dim: int) -> np.ndarray:
    """Doubles, one row for each vector of 4 or 8 bytes a component."""
    if all(len(x) == 4 * dim for x in vectors):
        return np.frombuffer(b"".join(vectors), "<f4").reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(x, "<f4" if len(x) == 4 * dim else "<f8").astype(np.float64) for x in vectors])


def block_links(ids: np.ndarray, sizes: np.ndarray, units: np.ndarray, codes: np.ndarray, left: np.ndarray, right: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Per member: vectors linked in this block and not in an earlier table; the smallest id joined to it here."""
    hit = np.zeros((len(ids), len(ids)), bool)
    l, r = np.flatnonzero(left), np.flatnonzero(right)
    hit[np.ix_(l, r)] = units[l] @ units[r].T >= threshold
    hit |= hit.T
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    if table:
        for s in range(0, len(a), 200_000):
            x, y = a[s : s + 200_000], b[s : s + 200_000]
            old = (codes[x, :table] == codes[y, :table]).any(axis=1)
            hit[x[old], y[old]] = False
    a, b = np.nonzero(hit)
    count = np.bincount(a, weights=sizes[b], minlength=len(ids)).astype(np.int64)
    joined = ids.copy()
    while len(a):
        new = joined.copy()
        np.minimum.at(new, a, joined[b])
        if (new == joined).all():
            break
        joined = new
    return count, joined


def links(classes: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """(id, n, link): sums of linked vectors, to be added up, and an id of the same component."""
    flat = classes.select("id", "label", "dim", F.posexplode("codes").alias("t", "code"))
    sizes = flat.groupBy("label", "dim", "t", "code").agg(F.count("*").alias("m")).where("m > 1")
    met = flat.join(sizes, ["label", "dim", "t", "code"])
    met = met.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", "t"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    groups = 1 + classes.count() // TOGETHER
    met = met.select("id", "label", "dim", "t", "code", "i", "j", "own", F.pmod(F.xxhash64("label", "dim", "code", "i", "j"), F.lit(groups)).alias("g"))
    kind = code_kind(bits)
    width = np.dtype(kind).itemsize

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, tables)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "size", "vector")), pa.array([x.tobytes() for x in codes], pa.binary())], ["id", "size", "vector", "codes"])

    small = classes.select("id", "size", "vector", "codes").mapInArrow(packed, "id long, size long, vector binary, codes binary")
    full = met.join(small, "id")

    def run(table: pa.Table) -> pa.Table:
        t = table.column("t")[0].as_py()
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        ids, size, own, dim, code, i, j = (table.column(c).to_numpy() for c in ("id", "size", "own", "dim", "code", "i", "j"))
        vectors, codes = table.column("vector").to_pylist(), table.column("codes").to_pylist()
        order = np.lexsort((j, i, code, dim, label))
        keys = np.stack([x[order] for x in (label, dim, code, i, j)])
        cut = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
        found: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            rows = order[a:b]
            if b - a > 1:
                unit = units(unpacked([vectors[x] for x in rows], int(dim[rows[0]])))
                met_at = np.frombuffer(b"".join([codes[x] for x in rows]), kind).reshape(len(rows), len(codes[rows[0]]) // width)
                count, joined = block_links(ids[rows], size[rows], unit, met_at, own[rows] == i[rows], own[rows] == j[rows], t, threshold)
                some = np.flatnonzero(count)
                found.append((ids[rows][some], count[some], joined[some]))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["id", "n", "link"])

    return full.groupBy("t", "g").applyInArrow(run, "id long, n long, link long")


def clusters(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    largest = vectors.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = plan(largest, threshold)
    rows = written(coded(vectors, bits, tables), "coded")
    able = rows.where("vec_id is not null and label is not null and dim is not null")
    key = ["label", "dim", "same1", "same2"]
    classes = written(able.groupBy(*key).agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("size")).withColumn("id", F.monotonically_increasing_id()), "classes", few=True)
    lead = able.dropDuplicates(["vec_id", *key]).join(classes, ["vec_id", *key])
    lead = written(lead.select("id", "size", "label", "dim", "vector", "codes"), "leaders")
    found = written(links(lead, threshold, bits, tables), "links", few=True)
    comps = written(components(found.select(F.col("id").alias("a"), F.col("link").alias("b"))), "components", few=True)
    rooted = classes.join(comps, "id", "left").withColumn("root", F.coalesce("component", "id"))
    least = written(rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count("*").alias("m")), "least", few=True)
    joined = hot_join(rooted, least, ["root"], "m", classes.count(), "id")
    linked = joined.join(found.groupBy("id").agg(F.sum("n").alias("n")), "id", "left")
    of_class = written(linked.select(*key, "size", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "of_class", few=True)
    discard(lead, found, comps, classes, least)
    told = hot_join(able.select("vec_id", *key), of_class, key, "size", rows.count(), "vec_id").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec_id is null or label is null or dim is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionAll(alone).withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
