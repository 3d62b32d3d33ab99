"""Near-duplicate documents by min-max hashing.

Both the smallest and the largest value under each permutation are kept, so 2 * ``PERMS`` signature values cost
``PERMS`` hash evaluations. Values are banded by ``ROWS``; a band never holds two values of one permutation. With 95
permutations there are 38 bands of 5: a pair at similarity 0.8 is missed with probability 3e-7, at 0.85 with 1e-9.

1. Documents with equal shingle sets are one class; its smallest id stands for it.
2. Classes meet in band buckets. Each bucket is led by the member that meets most others in all its buckets; every
   member is compared with its leader on full sets. That takes members, not pairs, and joins copies of one text.
3. Components of these links. Buckets that still hold several components, and more than the leader and one other, are
   compared in blocks of bounded size: first by one byte of each signature value, which leaves the members that have a
   partner in another component at similarity ``CLOSE`` or more (a pair at 0.8 falls below it with probability 1e-6),
   then those members on full sets. Nothing is emitted but members and one link for two components that meet.
4. Components of all links.

A class has a number of its own; documents' ids come in at the end, so classes that share a smallest id stay apart.

Defined results: no words or no text: empty set, on its own, component_id its id; fewer words than a shingle: the whole
sequence is the one shingle; a null id: on its own, component_id null and kept; rows that repeat an id are one document
that holds all their sets: they and what they link with have one component; empty input: empty output. Extra columns
play no part. Whole texts are hashed however long they are; a text of b bytes takes some 60 * b bytes in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, components, discard, hot_join, likely, marked, mix, packed, pieces, unpacked, utf8, word_hashes, written

PERMS = 95
ROWS = 5
BANDS = 2 * PERMS // ROWS
CLASS = ["set1", "set2", "n_shingles"]
BLOCK = 512  # members of a bucket that are compared at a time
WIDE = 1024  # the same, by signature bytes
CLOSE = 0.66  # similarity by signature bytes from which full sets are compared
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Different shingle hashes of concatenated texts, sorted by text and hash: row of the text, hash."""
    _, _, rows, words = word_hashes(offsets, data, lower=True)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    at = np.arange(len(words))
    first = np.r_[0, np.cumsum(n)][:-1]
    start = (at - first[rows] <= n[rows] - k) | ((at == first[rows]) & (n[rows] < k)) if len(at) else np.zeros(0, bool)
    own = at[start]
    size = np.minimum(k, n[rows[own]])
    value = np.zeros(len(own), np.uint64)
    for j in range(k):
        more = j < size
        value[more] = value[more] * _BASE + words[own[more] + j]
    value, row = mix(value + size.astype(np.uint64)), rows[own]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])] if len(row) else np.zeros(0, bool)
    return row[new], value[new]


def bands(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` texts that all have shingles: band keys, min bands then max bands; a byte of each signature value."""
    starts = np.searchsorted(row, np.arange(n))
    out = np.zeros((n, BANDS), np.uint64)
    sketch = np.zeros((n, 2 * PERMS), np.uint8)
    for p in range(PERMS):
        drawn = (value * _A[p] + _B[p]) >> np.uint64(32)
        for side, best in enumerate((np.minimum.reduceat(drawn, starts), np.maximum.reduceat(drawn, starts))):
            band = p // ROWS + side * (PERMS // ROWS)
            out[:, band] = out[:, band] * _BASE + best
            sketch[:, 2 * p + side] = (best * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)
    return mix(out + np.arange(1, out.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), sketch


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set1, set2 (together a 128-bit hash of the set), bands, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n = part.num_rows
                row, value = shingle_sets(*utf8(part.column("text")), k)
                size = np.bincount(row, minlength=n)
                full = np.flatnonzero(size)
                sums = set_sums(row, value, full, n)
                keys, sketch = np.zeros((0, BANDS), np.uint64), [b""] * n
                if len(full):
                    keys, found = bands(np.searchsorted(full, row), value, len(full))
                    for i, x in zip(full, found, strict=True):
                        sketch[i] = x.tobytes()
                ends = np.r_[0, np.cumsum((size > 0) * keys.shape[1])].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in sums), pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64))), pa.array(sketch, pa.binary())],
                    ["doc_id", "n_shingles", "set1", "set2", "bands", "sketch"],
                )

    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return here.mapInArrow(run, "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sketch binary")


def set_sums(row: np.ndarray, value: np.ndarray, full: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit hashes of each of ``n`` sets, 0 for those not in ``full``."""
    sums = np.zeros((2, n), np.uint64)
    if len(full):
        starts = np.searchsorted(row, full)
        for i in range(2):
            sums[i, full] = np.add.reduceat(mix(value + np.uint64(i + 1)), starts)
    return sums


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(id, shingles) for the classes ``wanted`` (``CLASS``, doc_id, id): their full sets, compressed. No text shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                n = part.num_rows
                row, value = shingle_sets(*utf8(part.column("text")), k)
                size = np.bincount(row, minlength=n)
                sums = set_sums(row, value, np.flatnonzero(size), n)
                cut = np.searchsorted(row, np.arange(n + 1))
                blobs = [packed(np.diff(value[a:b], prepend=np.uint64(0))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(x.view(np.int64)) for x in sums), pa.array(size.astype(np.int64)), pa.array(blobs, pa.binary())], ["doc_id", *CLASS, "shingles"])

    here = likely(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")), wanted.select(F.col("doc_id").alias("id"))).select("id", "text")
    found = here.mapInArrow(run, "doc_id long, set1 long, set2 long, n_shingles long, shingles binary")
    return found.join(wanted, ["doc_id", *CLASS]).select("id", "shingles").dropDuplicates(["id"])  # equal sets of one id


def _set(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have ``100 * intersection >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                if a != last[0]:
                    last = a, _set(batch.column(2)[i].as_py())
                x, y = last[1], _set(batch.column(3)[i].as_py())
                both = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_close(comp: np.ndarray, size: np.ndarray, sketch: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which members have a close partner in another component, left against right."""
    out = np.zeros(len(comp), bool)
    r = np.flatnonzero(right)
    for u in np.flatnonzero(left):
        v = r[(comp[r] != comp[u]) & (100 * np.minimum(size[r], size[u]) >= percent * np.maximum(size[r], size[u]))]
        if len(v):
            near = v[(sketch[v] == sketch[u]).sum(axis=1) >= CLOSE * sketch.shape[1]]
            out[near] = True
            out[u] |= len(near) > 0
    return out


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """Rows (key, n of the bucket, ...) dealt into pairs of blocks: i, j and side (0: the first block)."""
    here = members.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    here = here.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return here.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("blocks", "own", "other")


def close_members(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(key, id) of ``members`` (key, id, size, comp, n) that full sets must decide."""

    def run(table: pa.Table) -> pa.Table:
        key, ids, comp, size, side, i, j = (table.column(c).to_numpy() for c in ("key", "id", "comp", "size", "side", "i", "j"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
        near = block_close(comp, size, sketch, side == 0, side == (i[0] != j[0]), percent)
        return pa.table([pa.array(key[near]), pa.array(ids[near])], names=["key", "id"])

    return in_blocks(members, WIDE).join(sketches, "id").groupBy("key", "i", "j").applyInArrow(run, "key long, id long").distinct()


def block_links(ids: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, left against right: enough of them to join all that touch."""
    parent = {int(c): int(c) for c in comp}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    value = np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    out = []
    for u in np.flatnonzero(left):
        a, b = np.searchsorted(value, sets[u]), np.searchsorted(value, sets[u], "right")
        n = b - a
        spot = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(owner[spot], minlength=len(sets))
        for v in np.flatnonzero(right & (100 * both >= percent * (size + size[u] - both)) & (comp != comp[u])):
            x, y = root(int(comp[u])), root(int(comp[v]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(ids[u]), int(ids[v])))
    return out


def full_buckets(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within buckets: ``members`` (key, id, comp, n), all against all in blocks, on full sets."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, side, i, j = (table.column(c).to_numpy() for c in ("id", "comp", "side", "i", "j"))
        links = block_links(ids, comp, [_set(x) for x in table.column("shingles").to_pylist()], side == 0, side == (i[0] != j[0]), percent)
        return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    return in_blocks(members, BLOCK).join(sets, "id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def class_links(docs: DataFrame, known: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Written: (id, component) of the classes that anything links."""
    most = BANDS * classes.count()
    own = known.dropDuplicates(["doc_id", *CLASS]).join(classes.select(*CLASS, "doc_id", "id"), ["doc_id", *CLASS])
    flat = written(own.select("id", F.col("n_shingles").alias("size"), F.explode("bands").alias("key")), "flat")
    buckets = written(flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets", few=True)
    members = written(hot_join(flat, buckets.withColumn("m", F.col("n")), ["key"], "m", most, "id"), "members", few=True)
    discard(flat)

    score = members.groupBy("id").agg(F.sum("n").alias("score"))
    best = members.join(score, "id").groupBy("key").agg(F.max(F.struct("score", (-F.col("id")).alias("id"), "size")).alias("x"), F.max("n").alias("m"))
    leaders = written(best.select("key", "m", (-F.col("x.id")).alias("a"), F.col("x.size").alias("size_a")), "leaders", few=True)
    met = hot_join(members, leaders, ["key"], "m", most, "id").where(f"id <> a and 100 * least(size, size_a) >= {percent} * greatest(size, size_a)")
    pairs = written(met.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct(), "pairs", few=True)

    def fetched(ids: DataFrame) -> DataFrame:
        return sets_of(docs, classes.select("id", "doc_id", *CLASS).join(ids, "id", "left_semi"), k)

    sets = written(fetched(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()), "sets")
    links = verified(pairs, sets, percent)
    if (joined := same_id(known, classes)) is not None:
        links = links.unionAll(joined)
    links = written(links, "verified", few=True)
    comps = written(components(links), "components", few=True)
    discard(buckets, leaders, pairs, sets)

    placed = members.where("n > 2").join(comps, "id", "left").select("key", "id", "size", "n", F.coalesce("component", "id").alias("comp"))
    several = written(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("n").alias("m")).where("lo <> hi").select("key", "m"), "several", few=True)
    rest = written(hot_join(placed, several, ["key"], "m", most, "id"), "rest", few=True)
    near = written(close_members(rest, own.select("id", "sketch"), percent), "near", few=True)
    if near.limit(1).count():
        some = written(near.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("m")), "some", few=True)
        held = hot_join(rest.drop("n").join(near, ["key", "id"]), some, ["key"], "m", near.count(), "id").select("key", "id", "comp", "n")
        more = written(full_buckets(held, fetched(near.select("id").distinct()), percent), "more", few=True)
        if more.limit(1).count():
            comps = written(components(links.unionAll(more)), "components", few=True)
    discard(members, several, rest, near, links)
    return comps


def same_id(known: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (a, b) between the classes of rows that have one id and different texts; None if there are none."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in CLASS[:2] for f in (F.min, F.max)]
    several = known.groupBy("doc_id").agg(*ends).where("min_set1 <> max_set1 or min_set2 <> max_set2").select("doc_id")
    of_id = known.select("doc_id", *CLASS).join(several, "doc_id", "left_semi").distinct().join(classes.select(*CLASS, "id"), CLASS)
    of_id = written(of_id.select("doc_id", "id"), "same_id", few=True)
    if not of_id.limit(1).count():
        return None
    first = of_id.groupBy("doc_id").agg(F.min("id").alias("a"), F.count("*").alias("n"))
    return hot_join(of_id, first, ["doc_id"], "n", of_id.count(), "id").where("id <> a").select("a", F.col("id").alias("b"))


def clusters(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = written(signatures(docs, k), "signatures")
    known = rows.where("doc_id is not null and n_shingles > 0")
    classes = written(known.groupBy(*CLASS).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()), "classes", few=True)
    comps = class_links(docs, known, classes, k, percent)

    # the smallest document of each component, then of each class
    rooted = classes.join(comps, "id", "left").withColumn("root", F.coalesce("component", "id"))
    least = written(rooted.groupBy("root").agg(F.min("doc_id").alias("c"), F.count("*").alias("m")), "least", few=True)
    of_class = hot_join(rooted.select(*CLASS, "n", "id", "root"), least, ["root"], "m", classes.count(), "id")
    of_class = written(of_class.select(*CLASS, "n", "c"), "of_class", few=True)
    found = hot_join(known.select("doc_id", *CLASS), of_class, CLASS, "n", rows.count(), "doc_id").select("doc_id", "n_shingles", F.col("c").alias("component_id"))
    alone = rows.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    discard(classes, least)
    return found.unionAll(alone).withColumn("kept", F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id")))


def kept(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group; rows without an id stay.

    Only rows whose id may be that of a copy shuffle.
    """
    gone = written(clusters(docs.select("doc_id", "text"), k, percent).where("not kept").select(F.col("doc_id").alias("id")).distinct(), "gone", few=True)
    own = [f"c{i}" for i in range(len(docs.columns))]  # clashing names can't meet here
    here = marked(docs.toDF(*own).withColumn("id", F.col(own[docs.columns.index("doc_id")]).cast("long")), gone)
    return here.where("not __may").unionAll(here.where("__may").join(gone, "id", "left_anti").select(here.columns)).select(*own).toDF(*docs.columns)
