"""Quality rules by cross-document line frequency.

Lines are normalised (words lower-cased over A-Z, joined by one space) and hashed. Per host, the different documents
that hold a line are counted. A line held by more than ``max(min_docs, share * documents of the host)`` of them is over
the limit and is removed; a document that so loses more than ``max_lost`` of its words is depleted and rejected. The
base rules reject short and repetitive texts; they judge texts as they came, before lines are removed.

Documents are told apart by their ids, or (``distinct``) by their contents. By id, a page with more copies at a host than
the limit has all its lines over it, and every copy is rejected; by content its copies are one document. A pipeline that
keeps one document of each group later takes the latter.

Defined results: a null or empty text has no words and fails the base rules; a null host is a host of its own; a row
without an id is told apart by its content; rows that repeat an id are judged each, and counted once; a line at the limit
stays; lines without a word are never over a limit and stay; an empty table gives an empty one; extra columns stay in
``filtered``, whatever their names. Whole texts are measured however long they are; a text of b bytes takes some 20 * b
bytes in its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, hot_join, marked, mix, pieces, powers, utf8, windows, word_hashes, written

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<long>, line_words array<int>"


def stats(offsets: np.ndarray, data: np.ndarray) -> dict[str, np.ndarray | list]:
    """Base counts and normalised lines of concatenated texts, one entry per text."""
    n = len(offsets) - 1
    starts, ends, rows, words = word_hashes(offsets, data)
    lowered = word_hashes(offsets, data, lower=True)[3]
    full = np.flatnonzero(offsets[:-1] < offsets[1:])

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n, np.int64)
        if len(full):
            total[full] = np.add.reduceat(mask, offsets[full], dtype=np.int64)
        return total

    out: dict = {"n_words": np.bincount(rows, minlength=n), "word_chars": per_text(((data & 0xC0) != 0x80) & ~SPACE[data]), "n_symbols": per_text(SYMBOLS[data])}

    # words covered by 3-word windows that the text has twice or more
    at, h = windows(rows, words, 3)
    order = np.lexsort((h, rows[at]))
    same = np.r_[False, (h[order][1:] == h[order][:-1]) & (rows[at][order][1:] == rows[at][order][:-1])] if len(at) else np.zeros(0, bool)
    twice = np.zeros(len(at), bool)
    twice[order[same]] = True
    twice[order[np.flatnonzero(same) - 1]] = True
    edge = np.zeros(len(words) + 3, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 3, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(edge)[: len(words)] > 0], minlength=n)

    # lines with a word: as they are, and normalised
    cuts = np.unique(np.r_[offsets[:-1], np.flatnonzero(data == 10) + 1])
    line = np.searchsorted(cuts, starts, "right") - 1  # of each word
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    row, begin = rows[head], cuts[line[head]]
    n_words = np.diff(np.r_[head, len(line)])
    place = np.arange(len(line)) - np.repeat(head, n_words)
    key = mix(np.add.reduceat(lowered * powers(int(n_words.max()) if len(n_words) else 1)[place], head) + n_words.astype(np.uint64)) if len(head) else np.zeros(0, np.uint64)
    stop = np.r_[cuts[1:], len(data)][line[head]] if len(head) else head
    stop = stop - (data[stop - 1] == 10) if len(head) else stop  # without its \n
    plain = data.tobytes()
    raw = np.array([xxhash.xxh3_64_intdigest(plain[a:b]) for a, b in zip(begin, stop, strict=True)], np.uint64)
    order = np.lexsort((raw, row))
    again = np.r_[False, (raw[order][1:] == raw[order][:-1]) & (row[order][1:] == row[order][:-1])][: len(raw)]
    out["n_dup_lines"] = np.bincount(row[order[again]], minlength=n)
    bounds = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    out["lines"] = pa.ListArray.from_arrays(bounds, pa.array(key.view(np.int64)))
    out["line_words"] = pa.ListArray.from_arrays(bounds, pa.array(n_words.astype(np.int32)))
    out["content"] = np.array([xxhash.xxh3_64_intdigest(plain[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64).view(np.int64)
    return out


def measured(docs: DataFrame, host: str, rid: str | None = None) -> DataFrame:
    """Per row: rid (a column, or null), doc_id, host and ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines", "line_words"]
        for batch in batches:
            for part in pieces(batch, "__text"):
                found = stats(*utf8(part.column("__text")))
                cols = [x if isinstance(x := found[k], pa.Array) else pa.array(x.astype(np.int64)) for k in names]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "__text"), *cols], [x for x in part.schema.names if x != "__text"] + names)

    own = (F.lit(None) if rid is None else F.col(rid)).cast("long").alias("rid")
    here = docs.select(own, F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").alias("__text"))
    return here.mapInArrow(run, f"rid long, doc_id long, host string, {_OUT}")


def judged(docs: DataFrame, host: str = "source", min_docs: int = 20, share: float = 0.005, max_lost: float = 0.7, distinct: str = "doc_id", rid: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept, lost_words (in removed lines), rid, over_lines.

    ``over_lines`` are the places of the lines to remove among the text's lines with a word, from 0; null if none is.
    ``distinct`` says what tells two documents of a host apart: their ``doc_id``, or their ``content``. ``rid`` is the
    column of that name, or a number of our own.
    """
    named = F.concat(F.when(F.col("host").isNull(), "0").otherwise("1"), F.coalesce("host", F.lit("")))
    own = F.monotonically_increasing_id() if rid is None else F.col("rid")
    base = written(measured(docs, host, rid).withColumn("host", named).withColumn("rid", own), "measured")
    told = (F.col("content") if distinct == "content" else F.coalesce("doc_id", "content")).alias("told")
    hosts = base.groupBy("host").agg(F.countDistinct(told).alias("n_docs"))
    flat = base.select("rid", "host", told, F.posexplode(F.arrays_zip("lines", "line_words")).alias("place", "x"))
    lines = flat.select("rid", "host", "told", "place", F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    held = lines.groupBy("host", "line").agg(F.countDistinct("told").alias("n"), F.count("*").alias("m")).where(F.col("n") > min_docs)
    over = written(held.join(hosts, "host").where(F.col("n") > F.col("n_docs") * share).select("host", "line", "m"), "over", few=True)
    total = over.agg(F.sum("m")).first()[0] or 0
    lost = hot_join(lines, over, ["host", "line"], "m", total, "rid").groupBy("rid").agg(F.sum("words").alias("lost"), F.collect_list("place").alias("over_lines"))
    both = base.drop("content", "lines", "line_words").join(lost, "rid", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost_words = F.coalesce(F.col("lost"), F.lit(0)).cast("long")
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (lost_words <= max_lost * F.col("n_words"))).alias("kept"), lost_words.alias("lost_words"), "rid", "over_lines")


def without(text: str, over: list[int]) -> str:
    """``text`` without the lines at the places ``over`` among its lines with a word."""
    gone, place, out = set(over), -1, []
    for line in text.split("\n"):
        solid = bool(line.strip(BLANK))
        place += solid
        if not (solid and place in gone):
            out.append(line)
    return "\n".join(out)


def filtered(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept, their texts without the lines over the limit; all other columns as they are."""
    own = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: own[i] for i, c in enumerate(docs.columns)}
    text = place["text"]
    keyed = written(docs.toDF(*own).withColumn("__rid", F.monotonically_increasing_id()), "rows")  # numbered once for all
    host = how.pop("host", "source")
    view = keyed.select("__rid", F.col(place["doc_id"]).alias("doc_id"), F.col(text).alias("text"), F.col(place[host]).alias("host"))
    verdict = judged(view, host="host", rid="__rid", **how).where("not kept or over_lines is not null").select(F.col("rid").alias("id"), F.col("kept").alias("__kept"), F.col("over_lines").alias("__over"))
    odd = written(verdict, "odd", few=True)  # who goes or loses a line: the others' texts don't shuffle
    here = marked(keyed.withColumnRenamed("__rid", "id"), odd.select("id"))
    met = here.where("__may").join(odd, "id", "left").where(F.coalesce("__kept", F.lit(True))).select(*own, "__over")
    both = met.unionAll(here.where("not __may").select(*own, F.lit(None).cast("array<int>").alias("__over")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                at = part.schema.get_field_index(text)
                texts = [without(t, x) if x else t for t, x in zip(part.column(text).to_pylist(), part.column("__over").to_pylist(), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type)).drop_columns(["__over"])

    return both.mapInArrow(cut, both.drop("__over").schema).toDF(*docs.columns)
