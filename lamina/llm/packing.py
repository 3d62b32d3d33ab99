"""Packing by concatenate and cut.

Pass 1 tokenizes each text once and writes its ids with their place in the task's stream. The tasks' totals are summed
into global offsets; pass 2 cuts the stream into fixed windows and writes a record for each part of a document in a
window. Only the last sequence is short, so padding is at most one window.

Ids of a text are those of its white-space separated parts one after another (the tokenizer's pattern never matches
across white space), so parts are remembered by each Python worker; ``tests/llm`` holds this against whole texts.

Defined results: a null or empty text is its end id alone; repeated rows and null ids are packed each, in the order of
tasks and rows; a document that ends with a window leaves nothing over; an empty table gives an empty one; extra columns
play no part. Whole texts are tokenized however long they are: a text of b bytes takes some 20 * b bytes in its task.
"""

from __future__ import annotations

import codecs
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, written

END = 2
REMEMBERED = 128 << 20  # bytes of parts and ids, with what their objects take, that a worker remembers; then it starts anew
ENTRY = 180  # bytes of two objects and their place in a dictionary
BROADCAST_TASKS = 1_000_000  # offsets of 16 bytes
FLUSH = 1_000_000  # ids of a batch of pieces
_encoders: dict = {}


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as it is, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Encoder(dict):
    """From white-space separated parts of a text to their ids as little-endian 32-bit bytes, remembered.

    A part of letters, or of letters and then ASCII punctuation without an apostrophe, is one or two words of the
    tokenizer's pattern; its model gets them directly, in lower case. Any other part goes through the whole tokenizer
    as it came: special tokens are told by case, and capitals compose with marks that their small letters don't.
    """

    PUNCTUATION = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>")

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, "".join(byte_letters())
        self.runs: dict[bytes, bytes] = {}
        self.held = 0
        normal, split = self.tokenizer.normalizer.normalize_str("A\u00c9"), self.tokenizer.pre_tokenizer.pre_tokenize_str("ab,\u00e9")
        self.direct = normal == "a\u00e9" and [x for x, _ in split] == ["ab", ",", codecs.charmap_decode("\u00e9".encode(), "strict", self.letters)[0]]

    def run(self, word: bytes) -> bytes:
        found = array("I", [t.id for t in self.model.tokenize(codecs.charmap_decode(word, "strict", self.letters)[0])]).tobytes()
        self.runs[word] = found
        self.held += len(word) + len(found) + ENTRY
        return found

    def __missing__(self, part: bytes) -> bytes:
        if self.held > REMEMBERED:  # also within a text
            self.forget()
        core = part.rstrip(self.PUNCTUATION)
        tail, word = part[len(core) :], b""
        if self.direct and core:
            if core.isascii():
                word = core.lower() if core.isalpha() else b""
            elif unicodedata.is_normalized("NFC", text := core.decode()) and "\u03a3" not in text and (low := text.lower()).isalpha():
                word = low.encode()
        if word:
            runs = self.runs
            found = (runs.get(word) or self.run(word)) + ((runs.get(tail) or self.run(tail)) if tail else b"")
        else:
            found = array("I", self.tokenizer.encode(part.decode(), add_special_tokens=False).ids).tobytes()
        self[part] = found
        self.held += len(part) + len(found) + ENTRY
        return found

    def forget(self) -> None:
        self.clear(), self.runs.clear()
        self.held = 0

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [b"".join(map(self.__getitem__, self.folded((t or "").encode("utf-8", "replace")).split())) for t in texts]

    @staticmethod
    def folded(text: bytes) -> bytes:
        """The text with A-Z in lower case where that changes no id, so that fewer parts are remembered: special tokens
        hold ``<|``, and A-Z compose with none but the marks from U+0300 on, whose first bytes are 0xCC and 0xCD."""
        return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _squeezed(ids: bytes) -> bytes:
    import zstandard

    return zstandard.compress(np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _ids(blob: bytes) -> bytes:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).tobytes()


def tokenized(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Written: task, at (ids before it in the task's stream), doc_id, n (with the end id), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, task, at = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = [x + end for x in encode(part.column("text").to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), task, np.int32)), pa.array(at + np.cumsum(n) - n), part.column("doc_id"), pa.array(n), pa.array(map(_squeezed, ids), pa.binary())], ["task", "at", "doc_id", "n", "ids"])
                at += int(n.sum())

    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return written(here.mapInArrow(run, "task int, at long, doc_id long, n long, ids binary"), "tokens")


def placed(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, at (place of its first id in the whole stream), n, ids: one row per row of ``docs``."""
    tokens = tokenized(docs, path, text)
    totals = tokens.groupBy("task").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("task", before.alias("base"))  # one row per task
    base = F.broadcast(base) if tokens.select("task").distinct().count() <= BROADCAST_TASKS else base
    return tokens.join(base, "task").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "n", "ids")


def _cut(docs: DataFrame, path: str, window: int, text: str, last: str, kind: str, value: Callable[[bytes], object], column: Callable[[list], pa.Array]) -> DataFrame:
    """The parts of documents in windows; ``value`` of a part's ids goes to the column ``last``, which ``column`` builds."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", last]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in names]
        held = 0

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:-1]), column(out[-1])], names)
            for x in out:
                x.clear()
            return found

        for batch in batches:
            for doc, at, n, blob in (row for i in range(0, batch.num_rows, 500) for row in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns), strict=True)):
                ids, start = _ids(blob), 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(window - offset, n - start)
                    for x, v in zip(out, (doc, start, length, n, sequence, offset, value(ids[4 * start : 4 * (start + length)])), strict=True):
                        x.append(v)
                    start += length
                    held += length
                    if held >= FLUSH:
                        yield flush()
                        held = 0
        if out[0]:
            yield flush()

    return placed(docs, path, text).mapInArrow(cut, f"doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, {last} {kind}")


def _lists(parts: list[bytes]) -> pa.Array:
    stops = np.cumsum([0, *(len(x) // 4 for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def packed_ids(docs: DataFrame, path: str, window: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids: one row for each part of a document in a window.

    The ids of a sequence's rows one after another, by offset, are the packed sequence.
    """
    return _cut(docs, path, window, text, "ids", "array<int>", bytes, _lists)


def packed_pieces(docs: DataFrame, path: str, window: int = 4096, text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: ``packed_ids`` with a digest in place of the ids."""
    found = _cut(docs, path, window, text, "ids_crc32", "long", zlib.crc32, lambda x: pa.array(x, pa.int64()))
    return found.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
