"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. Nulls, empty and very long texts, ties, repeated
rows, empty tables and further columns are treated as each operator says; no stage drops a row for them but by its rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import linededup, mixing, neardup, packing, quality
from lamina.llm.common import discard, written
from lamina.llm.entries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs, distinct="content")  # copies are one document: near dedup keeps one of them


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept(docs, k=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_ids(docs, vocabulary())


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("packing", pack)]

ORACLE_SQL = None  # hashes and a tokenizer decide; tests/llm holds every stage's rows against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
            if held is not None:
                discard(held)  # nothing reads the stage before any more
            held = docs
    return docs
