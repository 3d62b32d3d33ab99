"""Known answers and choices made where specified and observed behaviour differ."""


import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.functions.bits import double_bits
from lamina.functions.sizes import bit_width, index_bytes
from lamina.operators import codecs, dictionary, encodings, layout, sharing, ude
from lamina.sources import footers, readers


def column(spark, values, kind="long"):
    return spark.createDataFrame(list(enumerate(values)), f"pos long, v {kind}")


def test_dictionary(spark):
    for values, entries, codes in (([1, 2, 3, 1, 2, 3, 1, 1, 3], [1, 2, 3], [0, 1, 2, 0, 1, 2, 0, 0, 2]), ([1, None, 3, 2, 3], [1, 3, 2], [0, None, 1, 2, 1])):
        df = column(spark, values)
        assert [r.value for r in dictionary.build(df, "v", "pos").orderBy("idx").collect()] == entries
        assert [r.idx for r in dictionary.encode(df, "v", "pos").orderBy("pos").collect()] == codes


def test_dictionary_merge(spark):
    a, b = (dictionary.build(column(spark, v), "v", "pos").select("idx", "value") for v in ([11, 1, 3, 4, 2, 6, 4, 3], [3, 5, 1, 2, 19, 2, 6]))
    m = dictionary.merged(a, b)
    assert [r.value for r in m.where("side = 'a'").orderBy("idx").collect()] == [3, 1, 2, 6, 11, 4]
    assert [r.value for r in m.where("side = 'b'").orderBy("idx").collect()] == [3, 1, 2, 6, 5, 19]


def test_sharing(spark):
    starts = [0, 13500, 39000, 3000, 13500]
    df = spark.range(10000).select(*((F.col("id") + s).alias(f"c{i}") for i, s in enumerate(starts)))
    p = sharing.pairs(sharing.long_values(df, df.columns))
    found = p.withColumn("merges", sharing.merges(F.col("n_i"), F.col("n_j"), F.col("jaccard"))).collect()
    assert {(r.i, r.j): (r.overlap, r.merges) for r in found} == {(0, 3): (7000, True), (1, 4): (10000, True)}
    assert sharing.matched([(r.i, r.j, r.jaccard) for r in found]) == [(1, 4), (0, 3)]


def test_widths(spark):
    df = spark.createDataFrame([(255, 0), (256, 1), (65535, 127), (65536, 128)], "n long, v long")
    got = df.select(index_bytes(F.col("n")).alias("a"), bit_width(F.col("v")).alias("b")).collect()
    assert [tuple(r) for r in got] == [(1, 0), (2, 1), (2, 7), (4, 8)]


def test_runs(spark):
    df = spark.range(65536).select(F.col("id").alias("pos"), F.when(F.col("id").between(7565, 7565 + 1364), 1).otherwise(0).alias("v"))
    assert [r.length for r in encodings.runs(df, "v", "pos", 65536).orderBy("run_id").collect()] == [7565, 1365, 56606]


def test_row_group_overshoots_by_whole_batches(spark):
    df = layout.placed(spark.range(4096).withColumnRenamed("id", "pos"), "pos", 600, 1000)
    assert [r["count"] for r in df.groupBy("row_group_id").count().orderBy("row_group_id").collect()] == [1200, 1200, 1200, 496]


def test_custom_unit_keeps_its_tail(spark):
    df = spark.range(100).select(layout.unit_id("id", 50, 20).alias("u"))
    assert [r["count"] for r in df.groupBy("u").count().orderBy("u").collect()] == [20, 20, 10, 20, 20, 10]


def test_list_offsets_and_round_trip(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5]), (2, [None]), (3, [6, 7, 8, 9]), (4, None), (5, [])], "pos long, a array<int>")
    o = encodings.list_offsets(df, "a", "pos", 100)
    assert [r.stop for r in o.orderBy("pos").collect()] == [3, 5, 6, 10, 10, 10]
    assert [r["items"] for r in encodings.to_lists(o, encodings.list_items(df, "a", "pos")).orderBy("pos").collect()] == [[1, 2, 3], [4, 5], [None], [6, 7, 8, 9], None, []]


def test_physical_columns():
    s = T.StructType().add("a", T.IntegerType()).add("l", T.ArrayType(T.StructType().add("b", T.IntegerType()).add("c", T.StringType())))
    assert [k for _, _, k in layout.physical_columns(s)] == ["int", "list", "struct", "int", "string"]
    assert [p for _, p, _ in layout.physical_columns(s, pushdown=True)] == ["a", "l.b", "l.c"]
    with pytest.raises(ValueError):
        layout.physical_columns(T.StructType().add("m", T.MapType(T.StringType(), T.StringType())))


def test_codecs_and_checksums(spark):
    for codec in codecs.CODECS:
        for data in (b"", b"x" * 1000):
            assert codecs.decompress(codecs.compress(data, codec), codec) == data
    df = spark.createDataFrame([(b"hello",), (b"",), (None,)], "b binary")
    assert [r[0] for r in df.select(codecs.xxh64(F.col("b"))).collect()] == [2794345569481354659, -1205034819632174695, None]
    assert codecs.ipc_decompress(codecs.ipc_compress(pa.array([1, None]))).to_pylist() == [1, None]


def test_damaged_units_are_found(spark):
    units = codecs.unit_bytes(column(spark, list(range(100))), "pos", "v", 10)
    stored = codecs.checksums(units)
    broken = units.withColumn("data", F.when(F.col("unit_id") == 3, F.concat("data", F.lit("!"))).otherwise(F.col("data")))
    assert [r.unit_id for r in codecs.verified(broken, stored).where("not valid").collect()] == [3]
    assert not codecs.verified(units, stored.where("unit_id <> 4")).where("unit_id = 4").first().valid
    with pytest.raises(Exception, match="checksum mismatch"):
        codecs.require_valid(codecs.verified(broken, stored)).collect()


def test_float_keys_are_bits(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert df.select(double_bits("x")).distinct().count() == 3


def test_user_defined_encodings(spark):
    arrays = {"noop": [1, None], "zstd": ["a", None], "lz4": [1.5], "gzip": ["é"], "bitpack": [0, 5, 2**40], "delta_bins": [5, 4, None, 2, None, -(10**12)], "symbols": ["abcabc", "", "é" * 9]}
    for name, values in arrays.items():
        e = ude.encoding(name)
        data = e.encode(pa.array(values))
        assert [x for part in e.decode(data) for x in part.to_pylist()] == values, name
    df = column(spark, [7, None, 9, 10**9, 3])
    assert [r.value for r in ude.decoded(ude.encoded(df, "v", "pos", 3, "delta_bins"), "delta_bins", 3, "long").orderBy("pos").collect()] == [7, None, 9, 10**9, 3]
    with pytest.raises(KeyError):
        ude.encoding("nothing")
    with pytest.raises(ValueError):
        ude.register("newer")(type("Newer", (ude.Noop,), {"version": (4, 0, 0)}))


def test_stateful_decode():
    data = ude.encoding("bitpack").encode(pa.array([i % 4 for i in range(3000)]))
    s = ude.Session("bitpack", data, ude.pack_kwargs({"equals": b"2"}))
    parts = []
    while (part := s.decode()) is not None:
        parts.append(part)
    assert len(parts) == 3 and sum(x for p in parts for x in p.to_pylist()) == 750
    assert ude.Session("bitpack", data, ude.pack_kwargs({"start": b"5", "stop": b"8"})).decode().to_pylist() == [1, 2, 3]


def test_json_schema():
    s = readers.json_schema([{"name": "a", "type": "bigint"}, {"name": "l", "type": {"type": "list", "element": {"type": "struct", "fields": [{"name": "x", "type": "double"}]}}}])
    assert s.simpleString() == "struct<a:bigint,l:array<struct<x:double>>>"
    with pytest.raises(ValueError):
        readers.json_type("map")


def test_window_dictionary_refuses_too_many_patterns(spark):
    df = spark.range(128 * 300).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    assert encodings.window_entries(df, "v", "pos", 128 * 300).where("code is not null").count() == 0




def test_footers_agree_with_another_reader(spark):
    import duckdb

    path = "/root/testdata/sf0.01/orders.parquet"
    got = footers.footers(spark, path).orderBy("row_group_id", "column_id").collect()
    want = duckdb.sql(f"SELECT row_group_id, column_id, path_in_schema, num_values, compression, total_compressed_size, total_uncompressed_size, row_group_num_rows FROM parquet_metadata('{path}') ORDER BY 1, 2").fetchall()
    assert [(r.row_group_id, r.column_id, r.path, r.num_values, r.compression, r.size, r.plain_size, r.num_rows) for r in got] == want
    p = footers.postscripts(spark, path).collect()[0]
    size = duckdb.sql(f"SELECT footer_size FROM parquet_file_metadata('{path}')").fetchall()[0][0]
    assert (p.file, p.footer_size, p.valid) == ("orders.parquet", size, True)


def test_files_that_workers_cannot_open_come_as_rows(spark, tmp_path, monkeypatch):
    import xxhash

    good = open("/root/testdata/sf0.001/region.parquet", "rb").read()
    (tmp_path / "a.parquet").write_bytes(good)
    (tmp_path / "b.parquet").write_bytes(good[:-4] + b"EVIL")
    (tmp_path / "c.parquet").write_bytes(b"xy")
    plain = [sorted(map(tuple, f(spark, str(tmp_path)).collect())) for f in (footers.checksums, footers.postscripts)]
    monkeypatch.setattr(footers, "NATIVE", set())
    whole = [sorted(map(tuple, f(spark, str(tmp_path)).collect())) for f in (footers.checksums, footers.postscripts)]
    assert plain == whole
    assert [r[2] for r in plain[0][:2]] == [int.from_bytes(xxhash.xxh64_digest(good[:-8]), "big", signed=True)] * 2
    assert [(r[0], r[3]) for r in plain[1]] == [("a.parquet", True), ("b.parquet", False), ("c.parquet", False)]


def test_a_unit_of_many_windows_is_stored_plainly(spark):
    df = spark.range(300 * 128).select(F.col("id").alias("pos"), (F.col("id") * 7).alias("v"))
    entries = encodings.window_entries(df, "v", "pos", 1 << 20)
    assert entries.where("code is null").count() == 300
    back = encodings.from_windows(entries)
    assert back.count() == 300 * 128 and back.where("value <> pos * 7").count() == 0


def test_types_tell_values_apart(spark):
    df = spark.createDataFrame([(i, str(i), i) for i in range(50)], "a long, b string, c long")
    found = sharing.pairs(sharing.long_values(df, df.columns)).collect()
    assert [(r.i, r.j, r.overlap) for r in found] == [(0, 2, 50)]


def test_a_dictionary_extended_is_the_dictionary_of_all(spark):
    df = column(spark, [5, 3, None, 5, 9, 3, 8, 9, 1, 5, None, 8])
    whole = {r.value: r.idx for r in dictionary.build(df, "v", "pos").collect()}
    before = dictionary.build(df.where("pos < 6"), "v", "pos")
    entries, codes = dictionary.extended(before, df.where("pos >= 6"), "v", "pos")
    assert {r.value: r.idx for r in entries.collect()} == whole
    assert {r.pos: r.idx for r in codes.collect()} == {i: whole.get(v) for i, v in enumerate([5, 3, None, 5, 9, 3, 8, 9, 1, 5, None, 8]) if i >= 6}


def test_ranks_across_strides(spark):
    df = spark.range(5).select((F.col("id") * 70_000).alias("o"))
    assert [r.r for r in dictionary.ranked(df, "o", "r").orderBy("o").collect()] == [0, 1, 2, 3, 4]


def test_typed_bins_and_array_packs():
    import numpy as np

    rng = np.random.default_rng(2)
    for kind in ude.TYPED:
        v = (rng.standard_normal(500) * 900).astype(kind)
        for mask in (None, rng.random(500) < 0.3):
            array = pa.array(v, mask=mask)
            assert pa.concat_arrays(list(ude.encoding("typed_bins").decode(ude.encoding("typed_bins").encode(array)))) .equals(array)
    for kind in ude.UNSIGNED:
        array = pa.array(rng.integers(0, 200, 2048).astype(kind))
        data = ude.encoding("arraypack").encode(array)
        assert pa.concat_arrays(list(ude.encoding("arraypack").decode(data))).equals(array) and len(data) == 2048 + 12
        assert ude.encoding("arraypack").first(data).equals(array[:1024])
    for bad in (pa.array([1, 2, 3]), pa.array([None] * 1024, pa.int64()), pa.array([-1] * 1024)):
        with pytest.raises(ValueError):
            ude.encoding("arraypack").encode(bad)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans_at_scale(spark):
    """No nested loop over data for selections, one scan for the study."""
    from lamina.operators import accounting

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    groups = layout.placed(orders, "o_orderkey", 1024, 4000).groupBy("row_group_id").agg(F.min("o_orderkey").alias("start"), F.count("*").alias("num_rows"))
    assert "NestedLoop" not in plan(layout.selection(spark.range(100).withColumnRenamed("id", "pos"), groups, 4000))
    study = accounting.study(orders, "o_orderkey", ["o_orderpriority", "o_orderstatus"], 1024, 4096)
    physical = study._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Scan parquet") == 1 and "PushedFilters" in physical


def test_chunks_of_a_long_row_group(spark):
    sizes = spark.range(20_000).select(F.lit(0).alias("column_id"), F.lit(0).cast("long").alias("row_group_id"), F.col("id").alias("unit_id"), F.lit(10).cast("long").alias("num_rows"), F.lit(7).cast("long").alias("bytes"))
    found = layout.cut_chunks(sizes, 20)
    assert found.where("chunk_id <> floor(unit_id / 3)").count() == 0


def test_rollup_of_a_stream(spark, tmp_path):
    from lamina.streaming import unit_rollup

    rows = [("2024-01-01 00:00:01", "ab"), ("2024-01-01 00:00:59", "c"), ("2024-01-01 00:01:00", "defg"), ("2024-01-01 00:09:00", "z")]
    spark.createDataFrame(rows, "t string, v string").select(F.col("t").cast("timestamp").alias("t"), "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, v string").parquet(str(tmp_path / "in"))
    query = unit_rollup(stream, "t", "1 minute", "1 minute", "v").writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.num_rows, r.bytes) for r in spark.table("rolled").orderBy("start").collect()] == [(2, 3), (1, 4), (1, 1)]


def test_scratch_tables_need_a_shared_folder_and_go(spark):
    from lamina.sources import scratch

    class Cluster:
        conf = {}  # noqa: RUF012

        class sparkContext:  # noqa: N801
            master, applicationId = "yarn", "x"

    with pytest.raises(RuntimeError):
        scratch.shared_folder(Cluster)
    df = scratch.written(spark.range(3), "numbers")
    path = df.scratch_path.removeprefix("file://")
    import os

    assert df.count() == 3 and os.path.isdir(path)
    scratch.discard(df)
    assert not os.path.exists(os.path.dirname(path))
