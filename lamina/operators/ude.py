"""User-defined encodings: a registry with versions, the choice of a decoder, arguments, and decoding to rows."""

from __future__ import annotations

import struct
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codecs import compress, decompress, ipc_compress, ipc_decompress

MAX_ABI = 3  # fixed value: the newest major version of the interface that is understood


class Encoding(ABC):
    """What users implement: arrays to bytes and back."""

    version = (1, 0, 0)

    def __init__(self, **kwargs: bytes) -> None:
        self.kwargs = kwargs

    @abstractmethod
    def encode(self, array: pa.Array) -> bytes: ...

    @abstractmethod
    def decode(self, data: bytes) -> Iterator[pa.Array]:
        """Parts of the array, one after another."""

    def first(self, data: bytes) -> pa.Array:
        """The first part alone."""
        return next(self.decode(data))

    def slice(self, data: bytes, start: int, stop: int) -> pa.Array:
        return pa.concat_arrays(list(self.decode(data))).slice(start, stop - start)


_registry: dict[str, type[Encoding]] = {}


def register(name: str):
    def put(cls: type[Encoding]) -> type[Encoding]:
        if cls.version[0] > MAX_ABI:
            raise ValueError(f"{name}: interface {cls.version[0]} is newer than {MAX_ABI}")
        _registry[name] = cls
        return cls

    return put


def known() -> dict[str, tuple[int, int, int]]:
    """Names and versions of all registered encodings."""
    return {n: c.version for n, c in sorted(_registry.items())}


def encoding(name: str, **kwargs: bytes) -> Encoding:
    if name not in _registry:
        raise KeyError(f"no encoding {name!r}; known: {sorted(_registry)}")
    return _registry[name](**kwargs)


@register("noop")
class Noop(Encoding):
    def encode(self, array: pa.Array) -> bytes:
        return ipc_compress(array)

    def decode(self, data: bytes) -> Iterator[pa.Array]:
        yield ipc_decompress(data)


class _Block(Encoding):
    codec = "none"

    def encode(self, array: pa.Array) -> bytes:
        sink = pa.BufferOutputStream()
        batch = pa.record_batch([array], ["v"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return compress(sink.getvalue().to_pybytes(), self.codec)

    def decode(self, data: bytes) -> Iterator[pa.Array]:
        yield from pa.ipc.open_stream(decompress(data, self.codec)).read_all().column("v").chunks


for _name in ("lz4", "zstd", "gzip"):
    register(_name)(type(f"Block{_name.title()}", (_Block,), {"codec": _name}))


VECTOR = 1024  # values of a vector


def unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` integers of ``width`` bits, lowest bit first."""
    bits = np.unpackbits(np.frombuffer(data[: -(-width * n // 8)], np.uint8), bitorder="little")[: width * n].reshape(n, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if n else np.zeros(0, np.uint64)


@register("bitpack")
class BitPack(Encoding):
    """Non-negative integers at the width of the largest; a trailer of width and length."""

    def encode(self, array: pa.Array) -> bytes:
        if array.null_count:
            raise ValueError("bitpack takes no nulls")
        v = array.to_numpy(zero_copy_only=False).astype(np.uint64)
        width = int(v.max(initial=0)).bit_length()
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return np.packbits(bits.ravel(), bitorder="little").tobytes() + struct.pack("<BQ", width, len(v))

    def decode(self, data: bytes) -> Iterator[pa.Array]:
        width, n = struct.unpack("<BQ", data[-9:])
        for i in range(0, max(n, 1), VECTOR):  # a vector starts at a whole byte: no other vector is touched
            yield pa.array(unpacked(data[i * width // 8 :], width, min(VECTOR, n - i)).astype(np.int64))


UNSIGNED = [np.uint8, np.uint16, np.uint32, np.uint64]  # by type id


@register("arraypack")
class ArrayPack(Encoding):
    """A whole array of unsigned integers at the width of its largest; a trailer of type id, width and length, each 4
    bytes. Lengths are multiples of 1024."""

    def encode(self, array: pa.Array) -> bytes:
        if array.null_count or len(array) % VECTOR:
            raise ValueError("arraypack takes no nulls and whole vectors")
        v = array.to_numpy(zero_copy_only=False)
        kind = v.dtype.type if v.dtype.type in UNSIGNED else np.uint64
        if v.dtype.type not in UNSIGNED and v.min(initial=0) < 0:
            raise ValueError("arraypack takes no negative values")
        v = v.astype(np.uint64)
        width = int(v.max(initial=0)).bit_length()
        bits = ((v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return np.packbits(bits.ravel(), bitorder="little").tobytes() + struct.pack("<III", UNSIGNED.index(kind), width, len(v))

    def decode(self, data: bytes) -> Iterator[pa.Array]:
        kind, width, n = struct.unpack("<III", data[-12:])
        for i in range(0, n, VECTOR):
            yield pa.array(unpacked(data[i * width // 8 :], width, VECTOR).astype(UNSIGNED[kind]))


@register("delta_bins")
class DeltaBins(Encoding):
    """Integers with nulls: a null bitmap, then differences at the least whole number of bytes, compressed."""

    def encode(self, array: pa.Array) -> bytes:
        valid = np.asarray(array.is_valid())
        v = array.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        d = np.diff(v, prepend=np.int64(0))
        zigzag = ((d << 1) ^ (d >> 63)).view(np.uint64)
        width = max(1, -(-int(zigzag.max(initial=0)).bit_length() // 8))
        body = zigzag.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        return struct.pack("<QQB", len(valid), len(v), width) + np.packbits(valid).tobytes() + compress(body, "zstd")

    def decode(self, data: bytes) -> Iterator[pa.Array]:
        n, m, width = struct.unpack("<QQB", data[:17])
        nb = -(-n // 8)
        valid = np.unpackbits(np.frombuffer(data[17 : 17 + nb], np.uint8))[:n].astype(bool)
        body = np.zeros((m, 8), np.uint8)
        if m:
            body[:, :width] = np.frombuffer(decompress(data[17 + nb :], "zstd"), np.uint8).reshape(width, m).T
        z = body.view("<u8").ravel()
        d = (z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64)
        out = np.zeros(n, np.int64)
        out[valid] = np.cumsum(d)
        yield pa.array(out, mask=~valid)


TYPED = [np.int16, np.int32, np.int64, np.uint16, np.uint32, np.uint64, np.float32, np.float64]  # by type id


@register("typed_bins")
class TypedBins(Encoding):
    """Numbers of any of these types, with nulls: a flag and bitmap of nulls, the type id, then the bits of the values
    as ``delta_bins``."""

    def encode(self, array: pa.Array) -> bytes:
        valid = np.asarray(array.is_valid())
        v = array.drop_null().to_numpy(zero_copy_only=False)
        nulls = b""
        if array.null_count:
            packed = np.packbits(valid, bitorder="little").tobytes()
            nulls = struct.pack("<I", len(packed)) + packed
        kind = TYPED.index(v.dtype.type)
        bits = np.ascontiguousarray(v).view(f"i{v.dtype.itemsize}").astype(np.int64)
        return struct.pack("<I", int(array.null_count > 0)) + nulls + struct.pack("<II", kind, len(valid)) + DeltaBins().encode(pa.array(bits))

    def decode(self, data: bytes) -> Iterator[pa.Array]:
        (flag,), at, valid = struct.unpack_from("<I", data), 4, None
        if flag:
            (size,) = struct.unpack_from("<I", data, at)
            valid = np.unpackbits(np.frombuffer(data[at + 4 : at + 4 + size], np.uint8), bitorder="little").astype(bool)
            at += 4 + size
        kind, n = struct.unpack_from("<II", data, at)
        kind = np.dtype(TYPED[kind])
        held = np.concatenate([x.to_numpy() for x in DeltaBins().decode(data[at + 8 :])]).astype(f"i{kind.itemsize}").view(kind)
        if valid is None:
            yield pa.array(held)
            return
        out = np.zeros(n, kind)
        out[valid[:n]] = held
        yield pa.array(out, mask=~valid[:n])


@register("symbols")
class Symbols(Encoding):
    """Strings over a table of up to 255 frequent 8-byte or shorter symbols; other bytes are escaped."""

    def encode(self, array: pa.Array) -> bytes:
        texts = [x.encode() for x in array.to_pylist()]
        seen: dict[bytes, int] = {}
        for t in texts:
            for size in (8, 4, 2, 1):
                for i in range(0, len(t) - size + 1, size):
                    seen[t[i : i + size]] = seen.get(t[i : i + size], 0) + size
        table = sorted(seen, key=lambda s: (-seen[s], s))[:255]
        code = {s: i for i, s in enumerate(table)}
        out, ends = bytearray(), []
        for t in texts:
            i = 0
            while i < len(t):
                for size in range(min(8, len(t) - i), 0, -1):
                    if (k := code.get(t[i : i + size])) is not None:
                        out.append(k)
                        i += size
                        break
                else:
                    out += bytes([255, t[i]])
                    i += 1
            ends.append(len(out))
        head = struct.pack("<HQ", len(table), len(texts)) + b"".join(bytes([len(s)]) + s for s in table)
        return head + np.array(ends, "<u8").tobytes() + bytes(out)

    def decode(self, data: bytes) -> Iterator[pa.Array]:
        n, m = struct.unpack("<HQ", data[:10])
        at, table = 10, []
        for _ in range(n):
            table.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        ends = np.frombuffer(data[at : at + 8 * m], "<u8").tolist()
        body, texts, begin = data[at + 8 * m :], [], 0
        for end in ends:
            t, i = bytearray(), begin
            while i < end:
                if body[i] == 255:
                    t.append(body[i + 1])
                    i += 2
                else:
                    t += table[body[i]]
                    i += 1
            texts.append(t.decode())
            begin = end
        yield pa.array(texts, pa.string())


def decoder(reader: list[Column], file: list[Column], custom: Column) -> Column:
    """'native' or 'bundled': the file's own decoder is needed for custom encodings, and where the file is newer than
    the reader by a version that breaks (another major, or anything while the major is 0)."""
    newer = F.struct(*reader) < F.struct(*file)
    return F.when(custom | (newer & ((reader[0] != file[0]) | (reader[0] == 0))), "bundled").otherwise("native")


def pack_kwargs(kwargs: dict[str, bytes]) -> bytes:
    """Count, then length-prefixed names and values, little-endian."""
    out = struct.pack("<I", len(kwargs))
    for k, v in sorted(kwargs.items()):
        out += struct.pack("<I", len(k.encode())) + k.encode() + struct.pack("<I", len(v)) + v
    return out


def unpack_kwargs(data: bytes) -> dict[str, bytes]:
    (n,), at, out = struct.unpack_from("<I", data), 4, {}
    for _ in range(n):
        parts = []
        for _ in range(2):
            (size,) = struct.unpack_from("<I", data, at)
            parts.append(data[at + 4 : at + 4 + size])
            at += 4 + size
        out[parts[0].decode()] = parts[1]
    return out


class Session:
    """Stateful decoding: arguments once, then part after part until None. A range or a constant to compare with may be
    among the arguments (``start``, ``stop``; ``equals``: the parts are then masks)."""

    def __init__(self, name: str, data: bytes, kwargs: bytes = pack_kwargs({})) -> None:
        self.args = unpack_kwargs(kwargs)
        own = encoding(name, **self.args)
        if "start" in self.args:
            self.parts = iter([own.slice(data, int(self.args["start"]), int(self.args["stop"]))])
        else:
            self.parts = own.decode(data)

    def decode(self) -> pa.Array | None:
        part = next(self.parts, None)
        if part is not None and "equals" in self.args:
            want = int(self.args["equals"])
            return pa.array([None if x is None else x == want for x in part.to_pylist()])
        return part


def encoded(df: DataFrame, value: str, pos: str, unit: int, name: str, multiple: int = 1) -> DataFrame:
    """(unit_id, n, data): a column's units through a registered encoding; a last unit is filled up with zeros to a
    ``multiple``, n tells how many values are its own."""
    own = _registry[name]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        array = table.column("value").combine_chunks()
        n = len(array)
        if n % multiple:
            array = pa.concat_arrays([array, pa.array([0] * (multiple - n % multiple), array.type)])
        return pa.table({"unit_id": table.column("unit_id")[:1], "n": pa.array([n], pa.int64()), "data": pa.array([own().encode(array)], pa.binary())})

    here = df.select(F.floor(F.col(pos) / unit).cast("long").alias("unit_id"), F.col(pos).alias("pos"), F.col(value).alias("value"))
    return here.groupBy("unit_id").applyInArrow(run, "unit_id long, n long, data binary")


def decoded(units: DataFrame, name: str, unit: int, kind: str, first: bool = False) -> DataFrame:
    """(pos, value): the units' own values as rows, part by part; or (``first``) those of their first vectors alone."""
    own = _registry[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n, data in zip(*(batch.column(c).to_pylist() for c in ("unit_id", "n", "data")), strict=True):
                at, left = i * unit, n
                for part in [own().first(data)] if first else own().decode(data):
                    part = part[:left]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), part.cast(kinds)], ["pos", "value"])
                    at += len(part)
                    left -= len(part)

    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[kind]
    return units.select("unit_id", "n", "data").mapInArrow(run, f"pos long, value {kind}")


# -- kinds of decoders ---------------------------------------------------------------------------------------------


def scalar_decoder(name: str) -> Callable[[Column], Column]:
    """One buffer in, one buffer out: the values' bytes, little-endian."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        own = encoding(name)
        return s.map(lambda x: None if x is None else b"".join(p.to_numpy(zero_copy_only=False).tobytes() for p in own.decode(bytes(x))))

    return run


def string_decoder(name: str) -> Callable[[Column], Column]:
    """One buffer in, two out: lengths (4 bytes each) and the strings' bytes."""

    @F.pandas_udf("lengths binary, data binary")
    def run(s: pd.Series) -> pd.DataFrame:
        own, out = encoding(name), []
        for x in s:
            texts = [t.encode() for part in own.decode(bytes(x)) for t in part.to_pylist()]
            out.append((np.array([len(t) for t in texts], "<u4").tobytes(), b"".join(texts)))
        return pd.DataFrame(out, columns=["lengths", "data"])

    return run


def from_buffers(units: DataFrame, unit: int) -> DataFrame:
    """(pos, value): rows from a scalar decoder's buffers (unit_id, data) of 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column("unit_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                v = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(i * unit + np.arange(len(v))), pa.array(v)], ["pos", "value"])

    return units.select("unit_id", "data").mapInArrow(run, "pos long, value long")


def from_string_buffers(units: DataFrame, unit: int) -> DataFrame:
    """(pos, value): rows from a string decoder's buffers (unit_id, lengths, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, lengths, data in zip(*(batch.column(c).to_pylist() for c in ("unit_id", "lengths", "data")), strict=True):
                ends = np.r_[0, np.cumsum(np.frombuffer(lengths, "<u4"))].astype(np.int32)
                strings = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([pa.array(i * unit + np.arange(len(strings))), strings], ["pos", "value"])

    return units.select("unit_id", "lengths", "data").mapInArrow(run, "pos long, value string")


class MergeInputs:
    """Several inputs in, rows out: parts of a unit that were encoded apart, one after another."""

    def eval(self, first: int, name: str, inputs: list[bytes]) -> Iterator[tuple[int, int]]:
        at = first
        for data in inputs:
            for part in encoding(name).decode(bytes(data)):
                for v in part.to_pylist():
                    yield at, v
                    at += 1


class DecodeSession:
    """Init with arguments, then decoding until None; what is still open when the input ends is closed."""

    def __init__(self) -> None:
        self.open: Session | None = None

    def eval(self, first: int, name: str, data: bytes, kwargs: bytes) -> Iterator[tuple[int, int]]:
        self.open = Session(name, bytes(data), bytes(kwargs))
        at = first
        while (part := self.open.decode()) is not None:
            for v in part.to_pylist():
                yield at, int(v)
                at += 1

    def terminate(self) -> None:
        self.open = None


def table_function(kind: type):
    """A table function of (pos, value) from one of the classes above."""
    from pyspark.sql.functions import udtf

    return udtf(kind, returnType="pos bigint, value bigint")
