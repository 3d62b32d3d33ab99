import pytest

from lamina import plans

from .oracle import compare, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert df.columns and df.count() >= 0
    else:
        assert compare(df, con, sql) == ""


def test_lists_hold_every_word_of_a_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 10 <> 3").collect()
    words = sum(len([w for w in (r.text or "").split(" ") if w]) for r in docs)
    made = {n: plans.queries()[n](spark, SF) for n in ("E20_list_offsets", "E22_list_items", "E24_list_reassembly", "T06_concat_arrays")}
    assert made["E22_list_items"].count() == words > 60 * len(docs)
    assert made["E20_list_offsets"].selectExpr("sum(stop - start)").first()[0] == words
    assert made["E24_list_reassembly"].selectExpr("sum(coalesce(size(items), 0))").first()[0] == words
    assert made["T06_concat_arrays"].selectExpr("sum(size(w) - 1)").first()[0] == words
