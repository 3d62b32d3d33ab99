"""Substring dedup: Rabin-Karp hashes of every window of ``k`` words, counted across the corpus.

A word goes if a window that covers it also starts in a document with a smaller id.

1. Each task hashes all windows of its texts and keeps one entry per hash and some millions of windows: the hash and
   the smallest id that has it. Larger ids of the same stretch are known losers and are told at once.
2. Entries move by hash, sorted and compressed in blocks. The owner of a hash finds the smallest id of all, and tells
   the others that they lose. A window that a third of all documents share makes one entry per stretch, not one per
   document, so no owner gets more of it than there are stretches.
3. Texts and lost (id, hash) pairs meet by id; repeated windows merge into maximal removal intervals.

A window is told by 96 bits: a hash of 64 and a check of 32 under another base. Among n different windows about
n*n / 2**97 are expected to meet another's by chance: 0.002 over the 1.6 * 10**13 windows of 100 TB. A document finds
its own lost windows by the 64 bits.

Defined results: a null or empty text has no words; rows with a null id are one document below all others, which so
loses nothing, and are dealt by their texts; rows that repeat an id are one document (no window of theirs counts against
the other); fewer than ``k`` words: nothing is removed; an empty table gives an empty one; extra columns play no part.
Whole texts are hashed however long they are; a text of b bytes takes some 40 * b bytes in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocked, blocks_for, id_or_least, packed, pieces, text_bytes, unblocked, unpacked, utf8, windows, word_hashes

OTHER_BASE = np.uint64(0x9FB21C651E98DF25)
MOST_TASKS = 100_000
STRETCH = 2_000_000  # windows that a task holds, some 100 bytes each while they are sorted


def owner(ids: np.ndarray, n: int) -> np.ndarray:
    """The block of an id; ``owner_column`` is the same in Spark."""
    return (ids ^ (ids >> 17)) % n


def owner_column(ids: Column, n: int) -> Column:
    return F.pmod(ids.bitwiseXOR(F.shiftright(ids, 17)), F.lit(n))


_SCHEMA = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("hashes", pa.binary()), ("checks", pa.binary())])
_SQL = "block long, kind int, ids binary, hashes binary, checks binary"
ENTRY, LOST = 0, 1
Windows = tuple[np.ndarray, np.ndarray, np.ndarray]  # ids, hashes, checks


def dealt(ids: np.ndarray, h: np.ndarray, checks: np.ndarray | None, to: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, kind, ids, hashes, checks), one for each block that gets something: entries, or without checks lost windows."""
    order = np.argsort(to, kind="stable")
    ids, h, to = ids[order], h[order], to[order]
    cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else []
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        delta = np.diff(h[a:b], prepend=np.uint64(0))  # sorted within a block: small steps
        check = None if checks is None else packed(checks[order[a:b]], "<u4")
        for x, v in zip(out, (int(to[a]), LOST if checks is None else ENTRY, packed(ids[a:b].view(np.uint64)), packed(delta), check), strict=True):
            x.append(v)
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)


def firsts(held: list[Windows]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (id, window) pairs ordered by window, then id; and whether a pair has the smallest id of its window."""
    ids, h, checks = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    if not len(h):
        return ids, h, checks, np.zeros(0, bool)
    order = np.lexsort((ids, checks, h))
    ids, h, checks = ids[order], h[order], checks[order]
    other = (h[1:] != h[:-1]) | (checks[1:] != checks[:-1])
    new = np.r_[True, other | (ids[1:] != ids[:-1])]
    first = np.r_[True, other][new]
    return ids[new], h[new], checks[new], first


def lost_windows(docs: DataFrame, k: int, n: int, stretch: int = STRETCH) -> DataFrame:
    """(block, ids, hashes): pairs of an id and a window that it loses, in blocks by id."""
    top = np.uint64(min(2**64 - 1, 2**64 // n + 1))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Windows] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                ids, h, checks, first = firsts(held)
                yield from dealt(ids[~first], h[~first], None, owner(ids[~first], n), n)
                yield from dealt(ids[first], h[first], checks[first], (h[first] // top).astype(np.int64), n)

        for batch in batches:
            for part in pieces(batch):
                ids = part.column("id").to_numpy(zero_copy_only=False)
                _, _, rows, words = word_hashes(*utf8(part.column("text")))
                at, h = windows(rows, words, k)
                checks = (windows(rows, words, k, OTHER_BASE)[1] >> np.uint64(32)).astype(np.uint32)
                held.append((ids[rows[at]], h, checks))
                if (size := size + len(h)) >= stretch:
                    yield from flush()
                    size = 0
        yield from flush()

    def losers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's rows come one after another."""
        now, held = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                ids, h, _, first = firsts(held)
                yield from dealt(ids[~first], h[~first], None, owner(ids[~first], n), n)

        for batch in batches:
            for i in range(batch.num_rows):
                block, kind = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if kind == LOST:
                    yield batch.slice(i, 1)
                    continue
                if block != now:
                    yield from settle()
                    now = block
                held.append((unpacked(batch.column(2)[i].as_py()).view(np.int64), np.cumsum(unpacked(batch.column(3)[i].as_py()), dtype=np.uint64), unpacked(batch.column(4)[i].as_py(), "<u4")))
        yield from settle()

    found = docs.select(id_or_least().alias("id"), "text").mapInArrow(entries, _SQL)
    tasks = min(n, MOST_TASKS)  # each with its own blocks: hashing them would give some tasks several
    spread = found.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "kind")
    return spread.mapInArrow(losers, _SQL).select("block", "ids", "hashes")


def removed_windows(docs: DataFrame, k: int = 13, n: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text."""
    n = n or blocks_for(docs.sparkSession, text_bytes(docs))
    lost = lost_windows(docs, k, n)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in zip(right.column("ids").to_pylist(), right.column("hashes").to_pylist(), strict=True):
            ids.append(unpacked(a).view(np.int64))
            h.append(np.cumsum(unpacked(b), dtype=np.uint64))
        ids, h = np.concatenate(ids), np.concatenate(h)
        order = np.argsort(ids, kind="stable")
        ids, h = ids[order], h[order]
        out = [[], [], [], []]
        for batch in unblocked(left.column("rows")):
            for part in pieces(batch):
                offsets, data = utf8(part.column("text"))
                _, _, rows, words = word_hashes(offsets, data)
                at, hashes = windows(rows, words, k)
                own = part.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                bounds = np.searchsorted(rows, np.arange(part.num_rows + 1))
                wins = np.searchsorted(rows[at], np.arange(part.num_rows + 1))
                for i, doc in enumerate(own):
                    a, b = np.searchsorted(ids, doc), np.searchsorted(ids, doc, "right")
                    first, last = bounds[i], bounds[i + 1]
                    keep = np.ones(last - first, bool)
                    if a < b:
                        gone = at[wins[i] : wins[i + 1]][np.isin(hashes[wins[i] : wins[i + 1]], h[a:b])] - first
                        edge = np.zeros(last - first + 1, np.int64)
                        np.add.at(edge, gone, 1)
                        np.add.at(edge, gone + k, -1)
                        keep = np.cumsum(edge)[:-1] == 0
                    raw = data[offsets[i] : offsets[i + 1]].tobytes()
                    text = b" ".join(w for w, y in zip(raw.split(), keep, strict=True) if y)
                    for x, v in zip(out, (part.column("doc_id")[i].as_py(), len(keep), int((~keep).sum()), text), strict=True):
                        x.append(v)
        kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary()
        cols = [pa.array(x, t) for x, t in zip(out, kinds, strict=True)]
        return pa.table([*cols[:3], cols[3].cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    # rows without an id lose nothing, wherever they are
    texts = blocked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.coalesce(owner_column(F.col("doc_id"), n), F.xxhash64("text")), n)
    both = texts.groupBy("block").cogroup(lost.groupBy("block"))
    return both.applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string")


def dedup_substrings(docs: DataFrame, k: int = 13, n: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space) per row of ``docs``."""
    return removed_windows(docs, k, n)


def substring_report(docs: DataFrame, k: int = 13, n: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row."""
    return removed_windows(docs, k, n).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], k: int = 13) -> dict[int, tuple[int, int, str]]:
    """What the report must hold, by plain Python over a few texts."""
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    least: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            least.setdefault(tuple(words[d][i : i + k]), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - k + 1) if least[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
