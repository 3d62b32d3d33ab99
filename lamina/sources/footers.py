"""Container metadata of Parquet files as relations, and checksums of whole files.

Only the ends of files are read where Python workers can open them (``NATIVE``); from a store that only Spark reads,
files come whole, as rows, so there a file must fit a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NATIVE = {"file", "s3", "s3a", "gs", "hdfs"}
MAGIC = b"PAR1"
STEP = 8 << 20  # bytes of a file that are held at a time
POSTSCRIPT = 8  # length of the footer and the magic


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every Parquet file; the content is null, and never read, where workers can open files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    schemes = {r[0] for r in found.select(F.regexp_extract("path", "^([a-z0-9]+):", 1)).distinct().collect()}  # a few
    return found.select("path", "length", F.lit(None).cast("binary").alias("content") if schemes <= NATIVE else F.col("content"))


def opened(path: str, content: bytes | None) -> pa.NativeFile:
    from pyarrow import fs

    if content is not None:
        return pa.BufferReader(content)
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, place = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")
    return store.open_input_file(place)


def _per_file(files: DataFrame, rows: Callable[[pa.NativeFile, int], list[dict]], schema: str) -> DataFrame:
    """``file`` (name) and what ``rows`` finds in each file."""
    kinds = files.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                name = row["path"].rsplit("/", 1)[-1]
                with opened(row["path"], row["content"]) as f:
                    yield pa.RecordBatch.from_pylist([{"file": name, **x} for x in rows(f, row["length"])], schema=arrow)

    return files.mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def postscripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, footer_size, valid): the last bytes of each file; a wrong magic or size makes it invalid."""

    def rows(f: pa.NativeFile, length: int) -> list[dict]:
        f.seek(max(0, length - POSTSCRIPT))
        end = f.read(POSTSCRIPT)
        size = int.from_bytes(end[:4], "little")
        return [{"length": length, "footer_size": size, "valid": end[4:] == MAGIC and size + POSTSCRIPT + len(MAGIC) <= length}]

    return _per_file(listed(spark, path), rows, "file string, length bigint, footer_size bigint, valid boolean")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column chunk of each row group, as the files' footers describe them."""

    def rows(f: pa.NativeFile, length: int) -> list[dict]:
        import pyarrow.parquet as pq

        meta, out = pq.ParquetFile(f).metadata, []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                x = group.column(c)
                first = x.dictionary_page_offset if x.has_dictionary_page and x.dictionary_page_offset else x.data_page_offset
                out.append({"version": meta.format_version, "created_by": meta.created_by, "row_group_id": g, "num_rows": group.num_rows, "column_id": c, "path": x.path_in_schema, "kind": x.physical_type, "num_values": x.num_values,
                            "compression": x.compression, "encodings": sorted(x.encodings), "dictionary": bool(x.has_dictionary_page), "offset": first, "size": x.total_compressed_size, "plain_size": x.total_uncompressed_size})
        return out

    schema = "file string, version string, created_by string, row_group_id int, num_rows bigint, column_id int, path string, kind string, num_values bigint, compression string, encodings array<string>, dictionary boolean, offset bigint, size bigint, plain_size bigint"
    return _per_file(listed(spark, path), rows, schema)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, length, checksum): xxHash64 (seed 0) of each file up to its postscript, streamed."""

    def rows(f: pa.NativeFile, length: int) -> list[dict]:
        h, left = xxhash.xxh64(), max(0, length - POSTSCRIPT)
        while left:
            part = f.read(min(STEP, left))
            if not part:
                raise OSError(f"{left} bytes short")
            h.update(part)
            left -= len(part)
        return [{"length": length, "checksum": int.from_bytes(h.digest(), "big", signed=True)}]

    return _per_file(listed(spark, path), rows, "file string, length bigint, checksum bigint")
