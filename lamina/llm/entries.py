"""Queries over the whole training-data tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, langid, linededup, mixing, neardup, packing, quality, secrets, sharding, substrings


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(_documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.labelled(_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_documents(spark, sf_dir), min_chars=40, min_docs=5)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(_documents(spark, sf_dir), vocabulary(), window=4096)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.clusters(_documents(spark, sf_dir), k=2, percent=80)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_documents(spark, sf_dir)).drop("rid", "over_lines")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_documents(spark, sf_dir), shards=16)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.col("target"), "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(_documents(spark, sf_dir), k=13)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_secret_scans, op2_language_id, op3_line_dedup, op4_packing, op5_minhash_near_dedup, op6_embedding_near_dedup, op7_quality_rules, op8_sharding, op9_mixing, op10_substring_dedup]
    return {f.__name__: f for f in found}


# DuckDB. Words are [^\x20\x09-\x0D]+; A-Z alone is lower-cased.
_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH lines AS (
  SELECT doc_id, i, l, regexp_replace({_LOWER.format('l')}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, i, l, common.k IS NOT NULL AND doc_id <> keeper AS gone FROM lines LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

_OP10 = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM windows JOIN firsts USING (s) WHERE first < doc_id), range(13) AS r(j)
), each_word AS (
  SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM words
), judged AS (
  SELECT e.doc_id, e.i, e.x, g.i IS NOT NULL AS gone FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
), counted AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM judged GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN counted USING (doc_id)"""

_OP6 = """
WITH RECURSIVE able AS MATERIALIZED (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM able a JOIN able b ON a.label = b.label AND len(a.e) = len(b.e) AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id <= coalesce(b, vec_id) AS kept
FROM embeddings LEFT JOIN least ON vec_id = least.a LEFT JOIN counted ON vec_id = counted.a"""

_OP7 = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('i' || doc_id, 't' || coalesce(text, '')) AS told, coalesce(text, '') AS t, coalesce('1' || source, '0') AS host, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), lines AS MATERIALIZED (
  SELECT rid, host, told, l, regexp_extract_all({_LOWER.format('l')}, {_WORD}) AS lw FROM (SELECT rid, host, told, unnest(string_split(t, chr(10))) AS l FROM docs)
), hosts AS (
  SELECT host, count(DISTINCT told) AS n_docs FROM docs GROUP BY host
), held AS (
  SELECT host, array_to_string(lw, ' ') AS k, count(DISTINCT told) AS n FROM lines WHERE len(lw) > 0 GROUP BY host, k HAVING count(DISTINCT told) > 20
), over_limit AS (
  SELECT host, k FROM held JOIN hosts USING (host) WHERE n > n_docs * 0.005::DOUBLE
), lost AS (
  SELECT rid, sum(len(lw)) AS lost FROM lines JOIN over_limit o ON lines.host = o.host AND array_to_string(lw, ' ') = k WHERE len(lw) > 0 GROUP BY rid
), again AS (
  SELECT rid, sum(n - 1) AS n_dup FROM (SELECT rid, l, count(*) AS n FROM lines WHERE len(lw) > 0 GROUP BY rid, l) GROUP BY rid
), windows AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n
  FROM (SELECT rid, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3))
), repeated AS (
  SELECT rid, count(DISTINCT i + j) AS n_rep FROM windows, range(3) AS r(j) WHERE n > 1 GROUP BY rid
), base AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost_words
  FROM docs LEFT JOIN again USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN lost USING (rid)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_words <= 0.7::DOUBLE * n_words AS kept, lost_words FROM failed"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _OP3, "op6_embedding_near_dedup": _OP6, "op7_quality_rules": _OP7, "op10_substring_dedup": _OP10}
