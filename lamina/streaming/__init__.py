"""Incremental variants on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_rollup(stream: DataFrame, time: str, lateness: str, window: str, value: str) -> DataFrame:
    """Size and count of a column per event-time window, as units are appended; late rows beyond the watermark drop."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, window)).agg(F.count("*").alias("num_rows"), F.sum(F.octet_length(value)).alias("bytes")).select(F.col("window.start").alias("start"), "num_rows", "bytes")
