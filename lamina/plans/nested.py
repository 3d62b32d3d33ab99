"""Lists and structs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encodings
from ..sources import readers
from .registry import UNIT, query

U = UNIT
_KEEP = "doc_id % 10 <> 3"
_LISTS = f"SELECT doc_id, CASE WHEN {_KEEP} THEN regexp_extract_all(text, '[^ ]+') END AS w FROM documents"


def _words(t):
    return t("documents").select("doc_id", F.when(F.expr(_KEEP), F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).alias("w"))


_OFFSETS = f"SELECT doc_id AS pos, w IS NOT NULL AS valid, (sum(coalesce(len(w), 0)) OVER x - coalesce(len(w), 0))::BIGINT AS start, (sum(coalesce(len(w), 0)) OVER x)::BIGINT AS stop FROM ({_LISTS}) WINDOW x AS (PARTITION BY floor(doc_id / 128) ORDER BY doc_id)"


@query("E20_list_offsets", _OFFSETS)
def _(t):
    return encodings.list_offsets(_words(t), "w", "doc_id", 128)


@query("E22_list_items", f"SELECT doc_id AS pos, (generate_subscripts(w, 1) - 1)::INTEGER AS i, unnest(w) AS item FROM ({_LISTS})")
def _(t):
    return encodings.list_items(_words(t), "w", "doc_id")


@query("E24_list_reassembly", f"SELECT doc_id AS pos, w AS items FROM ({_LISTS})")
def _(t):
    df = _words(t)
    return encodings.to_lists(encodings.list_offsets(df, "w", "doc_id", 128), encodings.list_items(df, "w", "doc_id"))


_TURNS = "SELECT conv_id, list({'turn': turn, 'role': role, 'size': length(text)} ORDER BY turn) AS turns FROM conversations GROUP BY conv_id"


def _turns(t):
    return t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("size")))).alias("turns"))


@query("E21_pushed_offsets", f"SELECT conv_id AS pos, (sum(len(turns)) OVER (PARTITION BY floor(conv_id / 128) ORDER BY conv_id) - len(turns))::BIGINT AS start, [x.role for x in turns] AS role FROM ({_TURNS})")
def _(t):
    df = _turns(t)
    offsets = encodings.list_offsets(df, "turns", "conv_id", 128).select("pos", "start")
    return offsets.join(df.select(F.col("conv_id").alias("pos"), F.transform("turns", lambda x: x["role"]).alias("role")), "pos")


@query("E23_struct_validity", "SELECT event_id AS pos, event_type <> 'click' AS valid FROM events")
def _(t):
    s = F.when(F.col("event_type") != "click", F.struct("event_type", "value"))
    return t("events").select(F.col("event_id").alias("pos"), s.isNotNull().alias("valid"))


@query("E25_struct_reassembly", "SELECT event_id AS pos, CASE WHEN event_type <> 'click' THEN event_type END AS kind, CASE WHEN event_type <> 'click' THEN value END AS value FROM events")
def _(t):
    parts = t("events").select(F.col("event_id").alias("pos"), (F.col("event_type") != "click").alias("valid"), "event_type", "value")
    whole = parts.select("pos", F.when(F.col("valid"), F.struct(F.col("event_type").alias("kind"), "value")).alias("s"))
    return whole.select("pos", "s.kind", "s.value")


@query("P10_point_access", f"SELECT [x.role for x in turns] AS role FROM ({_TURNS}) WHERE conv_id = 7")
def _(t):
    return _turns(t).where("conv_id = 7").select(F.transform("turns", lambda x: x["role"]).alias("role"))


@query("P11_point_access_pushed", f"SELECT [x.size for x in turns] AS size FROM ({_TURNS}) WHERE conv_id = 7")
def _(t):
    return _turns(t).where("conv_id = 7").select(F.col("turns.size").alias("size"))


@query("T06_concat_arrays", f"SELECT doc_id, coalesce(w, []::VARCHAR[]) || ['end'] AS w FROM ({_LISTS})")
def _(t):
    return _words(t).select("doc_id", F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit("end"))).alias("w"))


@query("I03_map_to_list", "SELECT event_id, CASE WHEN event_type <> 'click' THEN ['a', 'b'] END AS keys FROM events")
def _(t):
    m = F.when(F.col("event_type") != "click", F.create_map(F.lit("b"), F.col("value"), F.lit("a"), F.col("value")))
    df = t("events").select("event_id", m.alias("m"))
    return df.select("event_id", F.transform(readers.map_entries("m"), lambda x: x["key"]).alias("keys"))
