"""Scans, projections, predicates, dictionaries, sharing and encodings."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ..functions.sizes import bit_width, index_bytes
from ..operators import accounting, codecs, dictionary, encodings, layout, sharing, ude
from ..sources import readers
from ..sources.scratch import folder
from .registry import GROUP, UNIT, query

U = UNIT


# -- scans ---------------------------------------------------------------------------------------------------------
@query("S01_full_scan", "SELECT * FROM orders")
def _(t):
    return readers.Scan(f"{t.dir}/orders.parquet").load(t.spark)


@query("S05_metadata_read", "SELECT c::BIGINT AS n_columns, p::BIGINT AS projected, c <= 100 OR p / c::DOUBLE > 0.6 AS bulk FROM (VALUES (100, 1), (101, 1), (101, 60), (101, 61), (1000, 700)) v(c, p)")
def _(t):
    df = t.spark.createDataFrame([(100, 1), (101, 1), (101, 60), (101, 61), (1000, 700)], "n_columns long, projected long")
    return df.withColumn("bulk", layout.bulk_metadata(F.col("n_columns"), F.col("projected")))


@query("S10_batch_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    return readers.Scan(f"{t.dir}/lineitem.parquet", columns=["l_orderkey", "l_quantity"]).load(t.spark)


_THREE = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (5, 777, 1234)"


@query("S11_project_and_select", _THREE)
def _(t):
    return readers.Scan(f"{t.dir}/orders.parquet", columns=[0, 3], rows=[5, 777, 1234]).load(t.spark)


@query("S13_orc_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t):
    t("orders").write.orc(path := folder(t.spark, "orc"))
    return readers.Scan(path, "orc", columns=["o_orderkey", "o_orderstatus"]).load(t.spark)


@query("S16_csv_scan", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def _(t):
    df = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    readers.write_csv(df, path := folder(t.spark, "csv"))
    return readers.read_csv(t.spark, path, df.schema)


@query("S17_jsonl_scan", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    df = t("conversations").select("conv_id", "turn", "role", "text")
    df.write.json(path := folder(t.spark, "json"))
    names = {"bigint": "bigint", "int": "integer", "string": "varchar"}
    return t.spark.read.schema(readers.json_schema([{"name": n, "type": names[k]} for n, k in df.dtypes])).json(path)


# -- projections and selections ------------------------------------------------------------------------------------
@query("P01_project_by_index", "SELECT c_custkey, c_mktsegment FROM customer")
def _(t):
    return readers.Scan(f"{t.dir}/customer.parquet", columns=[0, 4]).load(t.spark)


@query("P03_select_one_row", "SELECT * FROM orders WHERE o_orderkey = 777")
def _(t):
    return readers.Scan(f"{t.dir}/orders.parquet", rows=[777]).load(t.spark)


_POSITIONS = [1499, 5, 777, 5, 10**9]
_GROUPS = f"SELECT floor(floor(o_orderkey / {U}) / {-(-GROUP // U)})::BIGINT AS row_group_id, min(o_orderkey) AS start, count(*) AS num_rows FROM orders GROUP BY 1"


def _row_groups(t):
    return layout.placed(t("orders"), "o_orderkey", U, GROUP).groupBy("row_group_id").agg(F.min("o_orderkey").alias("start"), F.count("*").alias("num_rows"))


@query("P04_process_selection", f"SELECT row_group_id, p - start AS local, p AS pos FROM (VALUES (1499::BIGINT), (5), (777), (5), (1000000000)) v(p), ({_GROUPS}) WHERE p >= start AND p < start + num_rows")
def _(t):
    return layout.selection(t.spark.createDataFrame([(p,) for p in _POSITIONS], "pos long"), _row_groups(t), GROUP)


@query("P05_chunk_of_row", f"SELECT 1234::BIGINT AS pos, floor(1234 / {U})::BIGINT AS unit_id, 1234 % {U}::BIGINT AS local, count(*) AS num_rows FROM orders WHERE floor(o_orderkey / {U}) = floor(1234 / {U})")
def _(t):
    units = t("orders").groupBy(F.floor(F.col("o_orderkey") / U).alias("unit_id")).agg(F.min("o_orderkey").alias("start"), F.count("*").alias("num_rows"))
    at = F.lit(1234).cast("long")
    return units.where((at >= F.col("start")) & (at < F.col("start") + F.col("num_rows"))).select(at.alias("pos"), "unit_id", (at - F.col("start")).alias("local"), "num_rows")


@query("P06_row_in_unit", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 1020 AND 1030")
def _(t):
    return t("orders").where(F.col("o_orderkey").between(1020, 1030)).select("o_orderkey", "o_orderpriority")


@query("P07_slice", "SELECT vec_id, embedding[5:8] AS part FROM embeddings", )
def _(t):
    return t("embeddings").select("vec_id", F.slice("embedding", 5, 4).alias("part"))


@query("P08_take", "SELECT p AS pos, o_orderpriority FROM (VALUES (1499::BIGINT), (5), (777), (5)) v(p) JOIN orders ON o_orderkey = p")
def _(t):
    wanted = t.spark.createDataFrame([(p,) for p in _POSITIONS], "pos long")
    return t("orders").join(wanted, F.col("o_orderkey") == F.col("pos")).select("pos", "o_orderpriority")


@query("P09_project_select_names", "SELECT o_orderpriority FROM orders WHERE o_orderkey IN (3, 1023, 1024)")
def _(t):
    return readers.Scan(f"{t.dir}/orders.parquet", columns=[5], rows=[3, 1023, 1024]).load(t.spark)


# -- predicates ----------------------------------------------------------------------------------------------------
for _name, _op, _sql in (("eq", "__eq__", "="), ("ne", "__ne__", "<>"), ("gt", "__gt__", ">"), ("ge", "__ge__", ">="), ("lt", "__lt__", "<"), ("le", "__le__", "<=")):

    @query(f"P12_mask_{_name}", f"SELECT o_orderkey AS pos, nullif(o_custkey % 10, 9) {_sql} 4 AS mask FROM orders")
    def _(t, _op=_op):
        c = F.nullif(F.col("o_custkey") % 10, F.lit(9))
        return t("orders").select(F.col("o_orderkey").alias("pos"), getattr(c, _op)(F.lit(4)).alias("mask"))


@query("P13_mask_and_or", "SELECT o_orderkey AS pos, (nullif(o_custkey % 10, 9) > 2 AND o_custkey % 10 < 7) OR o_orderstatus = 'F' AS mask FROM orders")
def _(t):
    c = F.nullif(F.col("o_custkey") % 10, F.lit(9))
    return t("orders").select(F.col("o_orderkey").alias("pos"), (((c > 2) & (F.col("o_custkey") % 10 < 7)) | (F.col("o_orderstatus") == "F")).alias("mask"))


@query("P14_mask_eq_constant", "SELECT event_id AS pos, event_type = 'click' AS mask FROM events")
def _(t):
    return t("events").select(F.col("event_id").alias("pos"), (F.col("event_type") == "click").alias("mask"))


@query("P15_position_set", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 13 = 0 AND o_orderstatus = 'O'")
def _(t):
    chosen = t("orders").where("o_orderkey % 13 = 0").select(F.col("o_orderkey").alias("pos"))
    hit = t("orders").where("o_orderstatus = 'O'").join(chosen, F.col("o_orderkey") == F.col("pos"), "left_semi")
    maps = hit.groupBy(F.expr("bitmap_bucket_number(o_orderkey)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(o_orderkey))").alias("m"))
    return maps.agg(F.sum(F.expr("bitmap_count(m)")).alias("n"))


@query("P16_partial_decode", "WITH d AS (SELECT o_orderpriority AS v, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1) SELECT o_orderkey AS pos, code, v AS value FROM orders JOIN d ON v = o_orderpriority")
def _(t):
    entries = dictionary.build(t("orders"), "o_orderpriority", "o_orderkey").drop("first")
    codes = dictionary.encode(t("orders"), "o_orderpriority", "o_orderkey")
    return codes.join(entries, ["scope", "idx"]).select("pos", F.col("idx").alias("code"), "value")


@query("P17_range_predicate", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 42 AND l_quantity > 0")
def _(t):
    return t("lineitem").where((F.col("l_quantity") < 42) & (F.col("l_quantity") > 0)).select("l_orderkey", "l_quantity")


@query("P18_first_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def _(t):
    df = t("lineitem")
    return df.select(df.columns[:8])


@query("P19_schema_probe", "SELECT * FROM orders LIMIT 0")
def _(t):
    return t("orders").limit(0)


# -- dictionaries --------------------------------------------------------------------------------------------------
_SCOPES = {"D03_local": f"floor(o_orderkey / {U})::BIGINT", "D04_global": "0::BIGINT", "D05_fixed": f"floor(floor(o_orderkey / {U}) / 4)::BIGINT"}

for _name, _scope in _SCOPES.items():

    @query(f"{_name}_dictionary", f"SELECT o_orderkey AS pos, {_scope} AS scope, (dense_rank() OVER (PARTITION BY {_scope} ORDER BY f) - 1)::BIGINT AS idx FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY {_scope}, o_custkey) AS f FROM orders)")
    def _(t, _name=_name):
        return dictionary.encode(t("orders"), "o_custkey", "o_orderkey", dictionary.strategies("o_orderkey", U, 4 * U)[_name[4:]])


_NULLED = "nullif(o_orderpriority, '1-URGENT')"
_BUILD = f"SELECT 0::BIGINT AS scope, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS idx, {_NULLED} AS value FROM orders WHERE {_NULLED} IS NOT NULL GROUP BY {_NULLED}"


def _nulled(t):
    return t("orders").withColumn("v", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")))


@query("D09_dictionary_build", f"WITH d AS ({_BUILD}) SELECT o_orderkey AS pos, 0::BIGINT AS scope, idx FROM orders LEFT JOIN d ON value = {_NULLED}")
def _(t):
    return dictionary.encode(_nulled(t), "v", "o_orderkey")


@query("D10_extend_index", f"WITH d AS ({_BUILD}) SELECT o_orderkey AS pos, idx FROM orders LEFT JOIN d ON value = {_NULLED} WHERE floor(o_orderkey / {U}) = 1")
def _(t):
    df = _nulled(t)
    before = dictionary.build(df.where(F.col("o_orderkey") < U), "v", "o_orderkey")
    return dictionary.extended(before, df.where(F.floor(F.col("o_orderkey") / U) == 1), "v", "o_orderkey")[1]


@query("D11_submit_values", _BUILD)
def _(t):
    return dictionary.build(_nulled(t), "v", "o_orderkey").drop("first")


@query("D13_index_width", "SELECT n, CASE WHEN n < 256 THEN 1 WHEN n < 65536 THEN 2 WHEN n < 4294967296 THEN 4 ELSE 8 END::BIGINT AS width FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders UNION ALL SELECT count(DISTINCT o_orderstatus) FROM orders UNION ALL SELECT * FROM (VALUES (255::BIGINT), (256), (65535), (65536), (4294967296)) v(n))")
def _(t):
    n = t("orders").agg(F.countDistinct("o_orderkey").alias("n")).unionAll(t("orders").agg(F.countDistinct("o_orderstatus"))).unionAll(t.spark.createDataFrame([(255,), (256,), (65535,), (65536,), (1 << 32,)], "n long"))
    return n.select("n", index_bytes(F.col("n")).alias("width"))


@query("D14_dictionary_decode", "SELECT o_orderkey AS pos, nullif(o_orderpriority, '1-URGENT') AS value FROM orders")
def _(t):
    return dictionary.decode(dictionary.encode(_nulled(t), "v", "o_orderkey"), dictionary.build(_nulled(t), "v", "o_orderkey"))


_PLAIN = "sum(octet_length(encode(o_orderpriority)) + 4)::BIGINT"


@query("D01_no_dictionary", f"SELECT {_PLAIN} AS plain_size FROM orders")
def _(t):
    return dictionary.plain(t("orders"), "o_orderpriority")


def _costs(scope: str) -> str:
    return f"SELECT sum(d)::BIGINT AS dict_size, sum(n * CASE WHEN e < 256 THEN 1 WHEN e < 65536 THEN 2 ELSE 4 END)::BIGINT AS index_size FROM (SELECT s, sum(octet_length(encode(v)) + 4) AS d, sum(m) AS n, count(v) AS e FROM (SELECT {scope} AS s, o_orderpriority AS v, count(*) AS m FROM orders GROUP BY 1, 2) GROUP BY s)"


@query("D02_encoder_dictionary", f"WITH u AS (SELECT floor(o_orderkey / {U})::BIGINT AS s, o_orderpriority AS v, count(*) AS m FROM orders GROUP BY 1, 2), c AS (SELECT s AS scope, sum((octet_length(encode(v)) + 4) * m)::BIGINT AS plain, (sum(octet_length(encode(v)) + 4) + sum(m))::BIGINT AS dict FROM u GROUP BY s) SELECT scope, plain, dict, least(plain, dict) AS best FROM c")
def _(t):
    scope = dictionary.strategies("o_orderkey", U, U)["local"]
    d = dictionary.sizes(t("orders"), "o_orderpriority", "o_orderkey", scope).select("scope", (F.col("dict_size") + F.col("index_size")).alias("dict"))
    p = t("orders").groupBy(scope[0].cast("long").alias("scope")).agg(F.sum(F.octet_length("o_orderpriority") + 4).alias("plain"))
    return p.join(d, "scope").select("scope", "plain", "dict", F.least("plain", "dict").alias("best"))


@query("D07_best_scope", f"SELECT l.dict_size + l.index_size AS local, g.dict_size + g.index_size AS global, CASE WHEN l.dict_size + l.index_size <= g.dict_size + g.index_size THEN 'local' ELSE 'global' END AS choice FROM ({_costs(f'floor(o_orderkey / {U})')}) l, ({_costs('0')}) g")
def _(t):
    s = dictionary.strategies("o_orderkey", U, U)
    one = {k: dictionary.total(t("orders"), "o_orderpriority", "o_orderkey", s[k]).select((F.col("dict_size") + F.col("index_size")).alias(k)) for k in ("local", "global")}
    return one["local"].crossJoin(one["global"]).withColumn("choice", dictionary.choose(F.col("local"), F.col("global")))  # one row each


_DRAWN = f"('0x' || substr(md5('unit:' || floor(o_orderkey / {U})::BIGINT::VARCHAR), 1, 13))::BIGINT % 10 < 3"
_SCALE = 10 / 3


def _sampled_sql(scope: str) -> str:
    return f"(SELECT coalesce(dict_size + index_size, 0) AS cost FROM ({_costs(scope).replace('FROM orders', f'FROM orders WHERE {_DRAWN}')}))"


@query("D08_sampled_scope", f"SELECT local, global, CASE WHEN local <= global THEN 'local' ELSE 'global' END AS choice FROM (SELECT l.cost * {_SCALE!r}::DOUBLE AS local, g.cost::BIGINT AS global FROM {_sampled_sql(f'floor(o_orderkey / {U})')} l, {_sampled_sql('0')} g)")
def _(t):
    """As D07 over every unit whose hash falls in three tenths, scaled up: a sampling operator."""
    s = dictionary.strategies("o_orderkey", U, U)
    unit = F.floor(F.col("o_orderkey") / U).cast("string")
    some = t("orders").where(F.conv(F.substring(F.md5(F.concat(F.lit("unit:"), unit)), 1, 13), 16, 10).cast("long") % 10 < 3)
    one = {k: dictionary.total(some, "o_orderpriority", "o_orderkey", s[k]).select((F.coalesce(F.col("dict_size") + F.col("index_size"), F.lit(0)) * (1 if k == "global" else _SCALE)).alias(k)) for k in ("local", "global")}
    return one["local"].crossJoin(one["global"]).withColumn("choice", dictionary.choose(F.col("local"), F.col("global")))  # one row each


_A = "SELECT row_number() OVER (ORDER BY min(l_orderkey)) - 1 AS idx, l_orderkey % 40 AS value FROM lineitem GROUP BY 2"


def _small_dicts(t):
    a = t("orders").select((F.col("o_orderkey") * 7 % 40).alias("v"), "o_orderkey")
    b = t("orders").select((F.col("o_orderkey") * 11 % 60 + 20).alias("v"), "o_orderkey")
    return dictionary.build(a, "v", "o_orderkey").select("idx", "value"), dictionary.build(b, "v", "o_orderkey").select("idx", "value")


_AB = "WITH a AS (SELECT o_orderkey * 7 % 40 AS value, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS idx FROM orders GROUP BY 1), b AS (SELECT o_orderkey * 11 % 60 + 20 AS value, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS idx FROM orders GROUP BY 1), c AS (SELECT a.value, row_number() OVER (ORDER BY b.idx) - 1 AS idx FROM a JOIN b USING (value))"


@query("D12_merge_dictionaries", f"{_AB} SELECT s AS side, c.idx, c.value, true AS common FROM c, (VALUES ('a'), ('b')) v(s) UNION ALL SELECT 'a', (SELECT count(*) FROM c) + row_number() OVER (ORDER BY idx) - 1, value, false FROM a WHERE value NOT IN (SELECT value FROM c) UNION ALL SELECT 'b', (SELECT count(*) FROM c) + row_number() OVER (ORDER BY idx) - 1, value, false FROM b WHERE value NOT IN (SELECT value FROM c)")
def _(t):
    return dictionary.merged(*_small_dicts(t)).select("side", F.col("idx").cast("long").alias("idx"), "value", "common")


@query("D16_dictionary_flush", f"{_AB} SELECT 'common' AS chunk, count(*) AS n, sum(8)::BIGINT AS size FROM c UNION ALL SELECT 'a', count(*), sum(8)::BIGINT FROM a WHERE value NOT IN (SELECT value FROM c) UNION ALL SELECT 'b', count(*), sum(8)::BIGINT FROM b WHERE value NOT IN (SELECT value FROM c)")
def _(t):
    return dictionary.flushed(dictionary.merged(*_small_dicts(t)), 8).select("chunk", "n", "size")


_FLUSHED = "f AS (SELECT row_number() OVER (ORDER BY place) - 1 AS dict_id, chunk, n, n * 8 AS size FROM (SELECT 0 AS place, 'common' AS chunk, count(*) AS n FROM c UNION ALL SELECT 1, 'a', count(*) FROM a WHERE value NOT IN (SELECT value FROM c) UNION ALL SELECT 2, 'b', count(*) FROM b WHERE value NOT IN (SELECT value FROM c)) WHERE n > 0)"
_REFS = f"{_AB}, {_FLUSHED}, r AS (SELECT side, dict_id, size FROM f, (VALUES ('a'), ('b')) v(side) WHERE chunk = 'common' OR chunk = side)"


@query("D17_dictionary_positions", f"{_REFS} SELECT side, list(dict_id ORDER BY dict_id) AS chunks FROM r GROUP BY 1")
def _(t):
    return dictionary.references(dictionary.flushed(dictionary.merged(*_small_dicts(t)), 8))


# -- sharing -------------------------------------------------------------------------------------------------------
_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LONG = " UNION ".join(f"SELECT {i}::INTEGER AS column_id, typeof({c}) AS kind, {c}::VARCHAR AS value FROM lineitem" for i, c in enumerate(_COLS))
_PAIRS = f"WITH v AS ({_LONG}), n AS (SELECT column_id, count(*) AS n FROM v GROUP BY 1), p AS (SELECT a.column_id AS i, b.column_id AS j, count(*) AS overlap FROM v a JOIN v b USING (kind, value) WHERE a.column_id < b.column_id GROUP BY 1, 2) SELECT i, j, x.n AS n_i, y.n AS n_j, overlap, round(overlap / (x.n + y.n - overlap)::DOUBLE, 6) AS jaccard FROM p JOIN n x ON x.column_id = i JOIN n y ON y.column_id = j"
_RULE = "jaccard >= 0.01 AND NOT ((n_i + n_j) * jaccard / (1 + jaccard) < 1024 AND jaccard < 0.99)"


@query("D19_jaccard", _PAIRS)
def _(t):
    return sharing.pairs(sharing.long_values(t("lineitem"), _COLS))


@query("D20_merge_rule", f"SELECT i, j, {_RULE} AS merges FROM ({_PAIRS})")
def _(t):
    return sharing.pairs(sharing.long_values(t("lineitem"), _COLS)).select("i", "j", sharing.merges(F.col("n_i"), F.col("n_j"), F.col("jaccard")).alias("merges"))


@query("D06_shared_dictionaries", f"WITH RECURSIVE e AS (SELECT i, j, row_number() OVER (ORDER BY jaccard DESC, i, j) AS r FROM ({_PAIRS}) WHERE {_RULE}), g(r, used, i, j, taken) AS (SELECT 0::BIGINT, []::INTEGER[], NULL::INTEGER, NULL::INTEGER, false UNION ALL SELECT e.r, CASE WHEN list_contains(used, e.i) OR list_contains(used, e.j) THEN used ELSE used || [e.i, e.j] END, e.i, e.j, NOT (list_contains(used, e.i) OR list_contains(used, e.j)) FROM g JOIN e ON e.r = g.r + 1) SELECT i, j FROM g WHERE taken")
def _(t):
    p = sharing.pairs(sharing.long_values(t("lineitem"), _COLS))
    edges = p.where(sharing.merges(F.col("n_i"), F.col("n_j"), F.col("jaccard"))).select("i", "j", "jaccard").collect()  # pairs of the columns named above
    return t.spark.createDataFrame(sharing.matched([tuple(e) for e in edges]), "i int, j int")


@query("D21_greedy_edges", f"SELECT i, j, jaccard, row_number() OVER (ORDER BY jaccard DESC, i, j) AS place FROM ({_PAIRS})")
def _(t):
    from pyspark.sql import Window

    p = sharing.pairs(sharing.long_values(t("lineitem"), _COLS))
    return p.select("i", "j", "jaccard", F.row_number().over(Window.orderBy(F.desc("jaccard"), "i", "j")).cast("long").alias("place"))


_HASHED = f"SELECT column_id, m::INTEGER AS m, ('0x' || substr(md5(m || ':' || value), 1, 13))::BIGINT AS h FROM ({_LONG}), range(3) r(m)"


@query("D18_bottom_k_sketch", f"SELECT column_id, m, h FROM ({_HASHED}) QUALIFY row_number() OVER (PARTITION BY column_id, m ORDER BY h) <= 256")
def _(t):
    return sharing.sketches(sharing.long_values(t("lineitem"), _COLS), 256)


@query("D22_value_hash", "SELECT o_orderkey, ('0x' || substr(md5('0:' || o_orderkey::VARCHAR), 1, 13))::BIGINT AS h FROM orders")
def _(t):
    return t("orders").select("o_orderkey", sharing.hashes(F.col("o_orderkey").cast("string"))[0].alias("h"))


@query("D19b_sketch_jaccard", f"WITH s AS (SELECT column_id, m, h FROM ({_HASHED}) WHERE column_id IN (0, 1) QUALIFY row_number() OVER (PARTITION BY column_id, m ORDER BY h) <= 256), u AS (SELECT m, h, count(*) AS n FROM s GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY m ORDER BY h) <= 256) SELECT round(avg(j), 6) AS jaccard FROM (SELECT m, avg((n = 2)::INTEGER::DOUBLE) AS j FROM u GROUP BY m)")
def _(t):
    return sharing.sketch_jaccard(sharing.sketches(sharing.long_values(t("lineitem"), _COLS), 256), 0, 1, 256)


# -- encodings -----------------------------------------------------------------------------------------------------
_BIN = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END::BIGINT"


@query("E04_bit_packing", f"SELECT block_id, n, w AS width, ceil(n * w / 8.0)::BIGINT AS bytes FROM (SELECT floor(o_orderkey / 1024)::BIGINT AS block_id, count(*) AS n, {_BIN.format('max(o_custkey)')} AS w FROM orders GROUP BY 1)")
def _(t):
    return encodings.bit_widths(t("orders"), "o_custkey", "o_orderkey")


@query("E05_bit_unpacking", "SELECT o_orderkey AS pos, o_custkey AS value FROM orders")
def _(t):
    return ude.decoded(ude.encoded(t("orders"), "o_custkey", "o_orderkey", 1024, "bitpack"), "bitpack", 1024, "long")


@query("E01_cascade", f"""WITH x AS (SELECT floor(o_orderkey / {U})::BIGINT AS unit_id, o_orderkey AS p, o_custkey % 50 AS v FROM orders), y AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(v) OVER w <> v THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY unit_id ORDER BY p)),
s AS (SELECT unit_id, count(*) AS n, min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS d, sum(new) AS r FROM y GROUP BY 1),
c AS (SELECT unit_id, ceil(n * {_BIN.format('hi')} / 8.0)::BIGINT AS bytes, 'bitpacked' AS scheme FROM s UNION ALL SELECT unit_id, 8, 'constant' FROM s WHERE lo = hi UNION ALL SELECT unit_id, d * 8 + n, 'dictionary' FROM s UNION ALL SELECT unit_id, 8 + ceil(n * {_BIN.format('(hi - lo)')} / 8.0)::BIGINT, 'for' FROM s UNION ALL SELECT unit_id, n * 8, 'plain' FROM s UNION ALL SELECT unit_id, (r * 12)::BIGINT, 'runend' FROM s)
SELECT unit_id, scheme, bytes FROM c QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY bytes, scheme) = 1""")
def _(t):
    return encodings.cascade(t("orders").withColumn("v", F.col("o_custkey") % 50), "v", "o_orderkey", U)


@query("E02_cascade_decode", "SELECT o_orderkey AS pos, o_custkey AS value FROM orders")
def _(t):
    return encodings.from_deltas(encodings.deltas(t("orders"), "o_custkey", "o_orderkey", U), U)


_RUNS = f"WITH x AS (SELECT floor(o_orderkey / {U})::BIGINT AS unit_id, o_orderkey AS p, o_orderstatus AS v FROM orders), y AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(v) OVER w IS DISTINCT FROM v THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY unit_id ORDER BY p)), z AS (SELECT *, sum(new) OVER (PARTITION BY unit_id ORDER BY p) - 1 AS run FROM y)"


@query("E08_run_end", f"{_RUNS} SELECT unit_id, run::BIGINT AS run_id, v AS value, max(p) + 1 AS run_end, count(*) AS length FROM z GROUP BY 1, 2, 3")
def _(t):
    return encodings.runs(t("orders"), "o_orderstatus", "o_orderkey", U)


@query("E08b_run_end_decode", "SELECT o_orderkey AS pos, o_orderstatus AS value FROM orders")
def _(t):
    return encodings.from_runs(encodings.runs(t("orders"), "o_orderstatus", "o_orderkey", U))


@query("E09_cascade_dictionary", "SELECT o_orderkey AS pos, (dense_rank() OVER (ORDER BY f) - 1)::BIGINT AS idx FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS f FROM orders)")
def _(t):
    return dictionary.encode(t("orders"), "o_orderstatus", "o_orderkey").select("pos", "idx")


_ALP = " UNION ALL ".join(f"SELECT floor(o_orderkey / {U})::BIGINT AS unit_id, {e}::BIGINT AS exponent, count(*) FILTER (round_even(o_totalprice * 1e{e}, 0) / 1e{e} = o_totalprice) AS matches FROM orders GROUP BY 1" for e in range(7))


@query("E10_alp", f"SELECT unit_id, exponent, matches FROM ({_ALP}) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY matches DESC, exponent) = 1")
def _(t):
    return encodings.alp_exponents(t("orders"), "o_totalprice", "o_orderkey", U)


@query("E12_date_parts", "SELECT event_id, floor(epoch_us(ts) / 86400000000)::BIGINT AS days, floor((epoch_us(ts) % 86400000000) / 1000000)::BIGINT AS seconds, epoch_us(ts) % 1000000 AS micros FROM events")
def _(t):
    return t("events").select("event_id", *encodings.date_parts(F.col("ts")))


@query("E13_position_bitmap", "SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def _(t):
    maps = t("events").where("event_type = 'click'").groupBy(F.expr("bitmap_bucket_number(event_id)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(event_id))").alias("m"))
    return maps.agg(F.coalesce(F.sum(F.expr("bitmap_count(m)")), F.lit(0)).alias("n"))


@query("E14_frame_of_reference", f"SELECT unit_id, n, base, w AS width, 8 + ceil(n * w / 8.0)::BIGINT AS bytes FROM (SELECT floor(o_orderkey / {U})::BIGINT AS unit_id, count(*) AS n, min(o_custkey) AS base, {_BIN.format('(max(o_custkey) - min(o_custkey))')} AS w FROM orders GROUP BY 1)")
def _(t):
    return encodings.framed(t("orders"), "o_custkey", "o_orderkey", U)


@query("E14b_delta", f"SELECT o_orderkey AS pos, o_custkey - coalesce(lag(o_custkey) OVER (PARTITION BY floor(o_orderkey / {U}) ORDER BY o_orderkey), 0) AS delta FROM orders")
def _(t):
    return encodings.deltas(t("orders"), "o_custkey", "o_orderkey", U)


@query("E15_constant", f"SELECT floor(event_id / 4)::BIGINT AS unit_id, min(event_type) = max(event_type) AS constant FROM events GROUP BY 1")
def _(t):
    return encodings.constants(t("events"), "event_type", "event_id", 4)


_WINDOWED = "(floor(o_orderkey / 128) % 5) * 1000 + o_orderkey % 128"


def _windowed(t):
    return t("orders").select("o_orderkey", (F.floor(F.col("o_orderkey") / 128) % 5 * 1000 + F.col("o_orderkey") % 128).alias("v"))


@query("E18_window_dictionary", f"WITH w AS (SELECT floor(o_orderkey / {U})::BIGINT AS unit_id, floor(o_orderkey / 128)::BIGINT AS window_id, list(({_WINDOWED})::BIGINT ORDER BY o_orderkey) AS p FROM orders GROUP BY 1, 2 HAVING count(*) = 128), f AS (SELECT *, min(window_id) OVER (PARTITION BY unit_id, p) AS first FROM w) SELECT unit_id, window_id, (dense_rank() OVER (PARTITION BY unit_id ORDER BY first) - 1)::BIGINT AS code FROM f")
def _(t):
    return encodings.window_entries(_windowed(t), "v", "o_orderkey", U).drop("pattern")


@query("E19_window_dictionary_decode", f"SELECT o_orderkey AS pos, ({_WINDOWED})::BIGINT AS value FROM orders WHERE floor(o_orderkey / 128) < (SELECT floor(count(*) / 128) FROM orders)")
def _(t):
    return encodings.from_windows(encodings.window_entries(_windowed(t), "v", "o_orderkey", U))


@query("E27_nullable_plain", "SELECT o_orderkey AS pos, nullif(o_orderpriority, '1-URGENT') IS NOT NULL AS valid, coalesce(nullif(o_orderpriority, '1-URGENT'), '') AS data FROM orders")
def _(t):
    return _nulled(t).select(F.col("o_orderkey").alias("pos"), F.col("v").isNotNull().alias("valid"), F.coalesce("v", F.lit("")).alias("data"))


@query("I08_ramp", "SELECT i AS id, i % 128 AS v FROM range(65536) r(i)")
def _(t):
    return t.spark.range(65536).select("id", (F.col("id") % 128).alias("v"))


@query("I15_window_benefit", f"SELECT count(*) * 8 AS plain, (SELECT count(*) FROM (SELECT DISTINCT list(({_WINDOWED})::BIGINT ORDER BY o_orderkey) FROM orders GROUP BY floor(o_orderkey / 128) HAVING count(*) = 128)) * 1024 AS patterns FROM orders")
def _(t):
    entries = encodings.window_entries(_windowed(t), "v", "o_orderkey", 1 << 30).select("pattern").distinct().agg((F.count("*") * 1024).alias("patterns"))
    return t("orders").agg((F.count("*") * 8).alias("plain")).crossJoin(entries)  # one row each


# -- checksums, codecs, versions -----------------------------------------------------------------------------------
_UNITS = f"SELECT floor(o_orderkey / {U})::BIGINT AS unit_id, md5(string_agg(o_orderpriority, chr(10) ORDER BY o_orderkey)) AS checksum FROM orders GROUP BY 1"


@query("C08_unit_checksum", _UNITS)
def _(t):
    return codecs.checksums(codecs.unit_bytes(t("orders"), "o_orderkey", "o_orderpriority", U))


@query("C09_verify_units", f"SELECT unit_id, unit_id <> 1 AS valid FROM ({_UNITS})")
def _(t):
    units = codecs.unit_bytes(t("orders"), "o_orderkey", "o_orderpriority", U)
    stored = codecs.checksums(units).withColumn("checksum", F.when(F.col("unit_id") == 1, "damaged").otherwise(F.col("checksum")))
    return codecs.verified(units, stored)


@query("C02_codec_round_trip", "SELECT doc_id, md5(text) AS lz4, md5(text) AS zstd, md5(text) AS gzip FROM documents")
def _(t):
    data = F.col("text").cast("binary")
    return t("documents").select("doc_id", *(F.md5(codecs.decompressed(codecs.compressed(data, c), c)).alias(c) for c in ("lz4", "zstd", "gzip")))


@query("C01_compressed_sizes")
def _(t):
    data = F.col("text").cast("binary")
    return t("documents").select("doc_id", *(F.octet_length(codecs.compressed(data, c)).cast("long").alias(c) for c in codecs.CODECS))


@query("C07_xxhash64")
def _(t):
    return t("documents").select("doc_id", codecs.xxh64(F.col("text").cast("binary")).alias("checksum"))


_VERSIONS = [(0, 21, 0, 0, 21, 0, False), (0, 21, 0, 0, 20, 0, False), (0, 21, 0, 0, 22, 0, False), (1, 2, 0, 1, 3, 0, False), (1, 2, 0, 2, 0, 0, False), (2, 0, 0, 1, 9, 9, False), (1, 0, 0, 1, 0, 0, True)]
_VALUES = ", ".join(f"({a}, {b}, {c}, {d}, {e}, {f}, {str(g).lower()})" for a, b, c, d, e, f, g in _VERSIONS)


@query("U16_abi_gate", "SELECT v::INTEGER AS major, v <= 3 AS accepted FROM range(6) r(v)")
def _(t):
    return t.spark.range(6).select(F.col("id").cast("int").alias("major"), (F.col("id") <= ude.MAX_ABI).alias("accepted"))


@query("U19_decoder_choice", f"SELECT *, CASE WHEN custom OR ((r0, r1, r2) < (f0, f1, f2) AND (r0 <> f0 OR r0 = 0)) THEN 'bundled' ELSE 'native' END AS decoder FROM (VALUES {_VALUES}) v(r0, r1, r2, f0, f1, f2, custom)")
def _(t):
    df = t.spark.createDataFrame(_VERSIONS, "r0 int, r1 int, r2 int, f0 int, f1 int, f2 int, custom boolean")
    return df.withColumn("decoder", ude.decoder([F.col(f"r{i}") for i in range(3)], [F.col(f"f{i}") for i in range(3)], F.col("custom")))


# -- sorts, limits, sets -------------------------------------------------------------------------------------------
@query("T01_sorted_positions", "SELECT p AS pos, row_number() OVER (ORDER BY p) AS place FROM (VALUES (1499::BIGINT), (5), (777), (5)) v(p)")
def _(t):
    from pyspark.sql import Window

    return t.spark.createDataFrame([(1499,), (5,), (777,), (5,)], "pos long").select("pos", F.row_number().over(Window.orderBy("pos")).cast("long").alias("place"))


@query("T02_bottom_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100")
def _(t):
    return t("orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").limit(100)


@query("T04_merge_with_limit", "SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 2 = 1) ORDER BY o_orderkey LIMIT 700")
def _(t):
    a, b = (t("orders").where(f"o_orderkey % 2 = {i}") for i in (0, 1))
    return readers.merged([a, b], "o_orderkey", 700).select("o_orderkey", "o_orderstatus")


@query("T05_union_files", "SELECT * FROM orders UNION ALL SELECT * FROM orders")
def _(t):
    p = f"{t.dir}/orders.parquet"
    return readers.merged([t.spark.read.parquet(p), t.spark.read.parquet(p)], "o_orderkey")


@query("T07_intersection", "SELECT l_partkey AS v FROM lineitem INTERSECT SELECT l_suppkey FROM lineitem")
def _(t):
    return t("lineitem").select(F.col("l_partkey").alias("v")).intersect(t("lineitem").select("l_suppkey"))


@query("T08_difference", "SELECT l_partkey AS v FROM lineitem EXCEPT SELECT l_suppkey FROM lineitem")
def _(t):
    return t("lineitem").select(F.col("l_partkey").alias("v")).subtract(t("lineitem").select("l_suppkey"))


@query("T09_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t("lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("T10_hash_sample", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('draw:' || o_orderkey::VARCHAR) LIMIT 150")
def _(t):
    """So many rows without replacement, by hash: a sampling operator."""
    return t("orders").select("o_orderkey", "o_totalprice").orderBy(F.md5(F.concat(F.lit("draw:"), F.col("o_orderkey").cast("string")))).limit(150)


# -- ingest and sinks ----------------------------------------------------------------------------------------------
@query("W15_parquet_sink", "SELECT * FROM customer")
def _(t):
    t("customer").write.parquet(path := folder(t.spark, "parquet"))
    return t.spark.read.parquet(path)


@query("W16_orc_sink", "SELECT * FROM customer")
def _(t):
    t("customer").write.orc(path := folder(t.spark, "orc"))
    return t.spark.read.orc(path)


@query("W20_rewrite_row_groups", "SELECT * FROM orders")
def _(t):
    readers.rewrite_parquet(t("orders"), path := folder(t.spark, "groups"), GROUP)
    return t.spark.read.parquet(path)


@query("W21_csv_to_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    df = t("customer")
    readers.write_csv(df, csv := folder(t.spark, "csv"))
    readers.rewrite_parquet(readers.read_csv(t.spark, csv, df.schema), path := folder(t.spark, "parquet"), GROUP)
    return t.spark.read.parquet(path)


@query("I02_retype", "SELECT l_orderkey, l_extendedprice::DOUBLE AS l_extendedprice, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::INTEGER AS l_shipdate FROM lineitem")
def _(t):
    return readers.retyped(t("lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("l_extendedprice"), F.col("l_shipdate").cast("date").alias("l_shipdate")))


@query("I04_concat_first_schema", "SELECT c_custkey, c_nationkey FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def _(t):
    a = t("customer").select("c_custkey", "c_nationkey")
    return readers.merged([a, t("supplier").select(F.col("s_suppkey").cast("int").alias("c_custkey"), F.col("s_nationkey").cast("long").alias("c_nationkey"))], "c_custkey")


_N, _ZIPF = 512, 1.03
_MASS = [k**-_ZIPF for k in range(1, _N + 1)]
_ENDS = [round(sum(_MASS[: i + 1]) / sum(_MASS) * 2**52) for i in range(_N)]  # of the windows' shares among 52-bit draws
_DRAW = "('0x' || substr(md5('w' || b::VARCHAR), 1, 13))::BIGINT"
_WINDOW = f"len(list_filter([{', '.join(f'{x}::BIGINT' for x in _ENDS[:-1])}], lambda e: e <= {_DRAW}))"
_VALUE = "(('0x' || substr(md5(w::VARCHAR || ':' || k::VARCHAR), 1, 13))::BIGINT % 2147483647)"


@query("I05_windows", f"SELECT id, {', '.join(f'v AS v{c}' for c in range(16))} FROM (SELECT b * 128 + k AS id, {_VALUE}::BIGINT AS v FROM (SELECT b, {_WINDOW}::BIGINT AS w FROM range(512) r(b)), range(128) s(k))")
def _(t):
    """512 windows of 128 values, each drawn among 512 patterns by a Zipf law; 16 equal columns."""
    def digest(c):
        return F.conv(F.substring(F.md5(c), 1, 13), 16, 10).cast("long")

    draw = t.spark.range(512).select(F.col("id").alias("window"), digest(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("u"))
    drawn = draw.select("window", F.size(F.filter(F.array(*map(F.lit, _ENDS[:-1])), lambda e: e <= F.col("u"))).cast("string").alias("w"))
    cells = drawn.select("window", "w", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("k")).select((F.col("window") * 128 + F.col("k")).alias("id"), "w")
    v = F.pmod(digest(F.concat("w", F.lit(":"), (F.col("id") % 128).cast("string"))), F.lit(2147483647))
    return cells.select("id", v.alias("v")).select("id", *(F.col("v").alias(f"v{c}") for c in range(16)))


@query("I06_wide_table", "SELECT " + ", ".join(f"42.0::DOUBLE AS column_{i}" for i in range(100)) + " FROM range(8)")
def _(t):
    return readers.wide(t.spark, 100)


_TEN = random.Random(42).sample(range(1000), 10)


@query("I07_ten_of_many", "SELECT " + ", ".join(f"42.0::DOUBLE AS column_{i}" for i in _TEN) + " FROM range(8)")
def _(t):
    return readers.wide(t.spark, 1000).select(*(f"column_{i}" for i in _TEN))


_SKEW = "CASE WHEN event_id * 7919 % 100 < 60 THEN 0 WHEN event_id * 7919 % 100 < 85 THEN 1 ELSE event_id * 7919 % 100 % 10 + 2 END"


@query("I09_skewed_values", f"SELECT event_id, ({_SKEW})::BIGINT AS v, ({_SKEW}) = 0 AS mask FROM events")
def _(t):
    u = F.col("event_id") * 7919 % 100
    v = F.when(u < 60, F.lit(0)).when(u < 85, F.lit(1)).otherwise(u % 10 + 2).cast("long")
    return t("events").select("event_id", v.alias("v"), (v == 0).alias("mask"))


# -- studies -------------------------------------------------------------------------------------------------------
def _study_sql(c: str) -> str:
    cost = lambda s: _costs(s).replace("o_orderpriority", c)
    total = lambda s: f"(SELECT dict_size + index_size FROM ({cost(s)}))"
    return f"SELECT '{c}' AS \"column\", (SELECT sum(octet_length(encode({c})) + 4)::BIGINT FROM orders) AS plain, {total(f'floor(o_orderkey / {U})')} AS local, {total(f'floor(floor(o_orderkey / {U}) / 4)')} AS fixed, {total('0')} AS global"


@query("A10_scope_study", "SELECT *, CASE least(plain, local, fixed, global) WHEN fixed THEN 'fixed' WHEN global THEN 'global' WHEN local THEN 'local' ELSE 'plain' END AS best FROM (" + " UNION ALL ".join(map(_study_sql, ("o_orderpriority", "o_orderstatus"))) + ")")
def _(t):
    return accounting.study(t("orders"), "o_orderkey", ["o_orderpriority", "o_orderstatus"], U, 4 * U)


@query("A11_scope_sweep", " UNION ALL ".join(f"SELECT {n * U}::BIGINT AS scope_rows, dict_size, index_size FROM ({_costs(f'floor(floor(o_orderkey / {U}) / {n})')})" for n in (2, 3, 4, 6, 8)))
def _(t):
    out = None
    for n in (2, 3, 4, 6, 8):
        row = dictionary.total(t("orders"), "o_orderpriority", "o_orderkey", dictionary.strategies("o_orderkey", U, n * U)["fixed"]).select(F.lit(n * U).cast("long").alias("scope_rows"), "dict_size", "index_size")
        out = row if out is None else out.unionByName(row)
    return out


@query("A06_encoding_counter", f"SELECT dict_size, index_size, dict_size + index_size AS total FROM ({_costs('0')})")
def _(t):
    return dictionary.total(t("orders"), "o_orderpriority", "o_orderkey").withColumn("total", F.col("dict_size") + F.col("index_size"))


@query("A08_compression_ratio", f"SELECT round((SELECT dict_size + index_size FROM ({_costs('0')})) / (SELECT {_PLAIN} FROM orders)::DOUBLE, 6) AS ratio")
def _(t):
    a, b = dictionary.total(t("orders"), "o_orderpriority", "o_orderkey"), dictionary.plain(t("orders"), "o_orderpriority")
    return a.crossJoin(b).select(F.round((F.col("dict_size") + F.col("index_size")) / F.col("plain_size"), 6).alias("ratio"))  # one row each


@query("A09_mean_nonzero", "SELECT floor(sum(user_id % 3) / count(*) FILTER (user_id % 3 <> 0))::BIGINT AS mean FROM events")
def _(t):
    return t("events").agg(accounting.mean_nonzero(F.col("user_id") % 3).alias("mean"))


def _references(t):
    """Chunks (dict_id, size) and who refers to them, as a merged pair of columns is written."""
    chunks = dictionary.flushed(dictionary.merged(*_small_dicts(t)), 8)
    refs = dictionary.references(chunks).select(F.when(F.col("side") == "a", 0).otherwise(1).alias("column_id"), F.explode("chunks").alias("dict_id"))
    return refs, chunks.select("dict_id", "size")


@query("A04_dictionary_sizes", f"{_REFS} SELECT CASE side WHEN 'a' THEN 0 ELSE 1 END::INTEGER AS column_id, sum(size)::BIGINT AS dict_size FROM r GROUP BY 1")
def _(t):
    return accounting.dictionary_sizes(*_references(t))


@query("A05_sharing_peers", f"{_REFS}, q AS (SELECT CASE side WHEN 'a' THEN 0 ELSE 1 END::INTEGER AS column_id, dict_id FROM r) SELECT DISTINCT x.column_id, y.column_id AS peer FROM q x JOIN q y ON x.dict_id = y.dict_id WHERE x.column_id <> y.column_id")
def _(t):
    return accounting.peers(_references(t)[0])


@query("A07_row_count", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return t("lineitem").agg(F.count("*").alias("n"))


@query("T03_multi_key_sort", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, 1, 2")
def _(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_returnflag", "l_linestatus")
