"""Every query with SQL, on the smallest of the driver's scales."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = {c: i for i, c in enumerate(rel.columns)}
    want = sorted(tuple(norm(r[order[c]]) for c in df.columns) for r in rel.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in df.collect()) == want


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["cname", "nname"]


def test_table_function_meets_parts_of_every_size(spark):
    sizes = spark.read.parquet(f"{SF}/part.parquet").where("p_size >= 1")
    assert entry.queries()["table_function"](spark, SF).count() == sizes.selectExpr("sum(p_size)").first()[0]


def test_graph_facts_through_ntriples_have_tags_types_and_blank_nodes(spark):
    df = entry.queries()["ntriples_graph_roundtrip"](spark, SF)
    kinds = df.selectExpr("count(lang)", "count(dt)", "count_if(o_kind = 'B')", "count_if(o_kind = 'I')").first()
    assert min(kinds) > 0
