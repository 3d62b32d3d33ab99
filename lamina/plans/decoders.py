"""Registered encodings by query: what each stores, and every way to decode it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ude
from .registry import UNIT, query

U = UNIT
_BIN = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END::BIGINT"
_KEYS = "SELECT o_orderkey AS pos, o_custkey AS value FROM orders"
_WORDS = "SELECT o_orderkey AS pos, o_orderpriority AS value FROM orders"


def _keys(t, name: str, multiple: int = 1, unit: int = U):
    return ude.encoded(t("orders"), "o_custkey", "o_orderkey", unit, name, multiple)


def _strings(t, name: str):
    return ude.encoded(t("orders"), "o_orderpriority", "o_orderkey", U, name)


@query("E03_first_vector", f"SELECT o_orderkey AS pos, o_custkey AS value FROM orders WHERE o_orderkey % {4 * U} < {U}")
def _(t):
    return ude.decoded(_keys(t, "bitpack", unit=4 * U), "bitpack", 4 * U, "long", first=True)


@query("E06_array_bit_packing", f"SELECT unit_id, n, w AS width, (ceil(n / {U}.0) * {U} * w / 8 + 12)::BIGINT AS bytes FROM (SELECT floor(o_orderkey / {U})::BIGINT AS unit_id, count(*) AS n, {_BIN.format('max(o_custkey)')} AS w FROM orders GROUP BY 1)")
def _(t):
    width = F.conv(F.hex(F.reverse(F.substring("tail", 5, 4))), 16, 10).cast("long")
    units = _keys(t, "arraypack", 1024).withColumn("tail", F.expr("substring(data, -12, 12)"))
    return units.select("unit_id", "n", width.alias("width"), F.octet_length("data").cast("long").alias("bytes"))


@query("E07_array_bit_unpacking", _KEYS)
def _(t):
    return ude.decoded(_keys(t, "arraypack", 1024), "arraypack", U, "long")


@query("E11_symbol_strings", _WORDS)
def _(t):
    return ude.decoded(_strings(t, "symbols"), "symbols", U, "string")


@query("E16_delta_bins", "SELECT o_orderkey AS pos, nullif(o_custkey, 3) AS value FROM orders")
def _(t):
    df = t("orders").withColumn("v", F.nullif(F.col("o_custkey"), F.lit(3).cast("long")))
    return ude.decoded(ude.encoded(df, "v", "o_orderkey", U, "delta_bins"), "delta_bins", U, "long")


@query("E17_typed_bins", "SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS value FROM orders")
def _(t):
    df = t("orders").withColumn("v", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    return ude.decoded(ude.encoded(df, "v", "o_orderkey", U, "typed_bins"), "typed_bins", U, "double")


for _id, _codec in (("C03_lz4", "lz4"), ("C04_arrow_ipc_lz4", "noop"), ("C05_gzip", "gzip"), ("C06_zstd", "zstd")):

    @query(f"{_id}_encoding", _WORDS)
    def _(t, _codec=_codec):
        return ude.decoded(_strings(t, _codec), _codec, U, "string")


@query("U04_scalar_decode", _KEYS)
def _(t):
    units = _keys(t, "bitpack").select("unit_id", ude.scalar_decoder("bitpack")(F.col("data")).alias("data"))
    return ude.from_buffers(units, U)


@query("U05_string_decode", _WORDS)
def _(t):
    units = _strings(t, "symbols").select("unit_id", ude.string_decoder("symbols")(F.col("data")).alias("b"))
    return ude.from_string_buffers(units.select("unit_id", "b.lengths", "b.data"), U)


@query("U06_decode_to_rows", _WORDS)
def _(t):
    return ude.decoded(_strings(t, "zstd"), "zstd", U, "string")


@query("U07_several_inputs", _KEYS)
def _(t):
    """Units of a quarter, encoded apart; each call decodes four."""
    parts = _keys(t, "bitpack", unit=U // 4).withColumn("at", F.floor(F.col("unit_id") / 4).cast("long"))
    inputs = parts.groupBy("at").agg(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "data"))), lambda x: x["data"]).alias("inputs"))
    merge = ude.table_function(ude.MergeInputs)
    return inputs.lateralJoin(merge((F.col("at") * U).outer(), F.lit("bitpack"), F.col("inputs").outer())).select("pos", "value")


def _session(t, **kwargs: bytes):
    run = ude.table_function(ude.DecodeSession)
    args = F.lit(ude.pack_kwargs(kwargs))
    return _keys(t, "bitpack").lateralJoin(run((F.col("unit_id") * U).outer(), F.lit("bitpack"), F.col("data").outer(), args)).select("pos", "value")


@query("U09_session", _KEYS)
def _(t):
    return _session(t)


@query("U09b_session_mask", "SELECT o_orderkey AS pos, (o_custkey = 7)::BIGINT AS value FROM orders")
def _(t):
    return _session(t, equals=b"7")


@query("U10_kwargs", "SELECT c_custkey, ['key', 'segment'] AS names, [c_custkey::VARCHAR, c_mktsegment] AS \"values\" FROM customer")
def _(t):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = [ude.unpack_kwargs(ude.pack_kwargs({"segment": s.encode(), "key": str(k).encode()})) for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(x) for x in out]), pa.array([[v.decode() for v in x.values()] for x in out])], ["c_custkey", "names", "values"])

    df = t("customer").select("c_custkey", "c_mktsegment")
    return df.mapInArrow(run, f"c_custkey {df.dtypes[0][1]}, names array<string>, values array<string>")


_KNOWN = ("arraypack", "bitpack", "delta_bins", "gzip", "lz4", "noop", "symbols", "typed_bins", "zstd")


@query("U22_registry", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', 1::INTEGER, true)" for n in _KNOWN) + ") v(name, major, accepted)")
def _(t):
    return t.spark.createDataFrame([(n, v[0], v[0] <= ude.MAX_ABI) for n, v in ude.known().items()], "name string, major int, accepted boolean")
