import datetime as dt
from decimal import Decimal

import pytest

from tripleloom.operators.wide import ordinals, wide_table

ATTRS = [(1, "n", "integer"), (2, "n", "integer"), (3, "d", "decimal"), (4, "f", "double"), (5, "b", "boolean"), (6, "day", "date"), (7, "at", "datetime"), (8, "link", "iri"), (9, "s", "string")]
TERMS = [(100, "L", " 12 ", None), (101, "L", "x", None), (102, "L", "1.50", None), (103, "L", "-INF", None), (104, "L", "0", None), (105, "L", "2024-02-29Z", None), (106, "L", "2023-02-29", None), (107, "L", "2024-01-01T24:00:00", None), (108, "I", "http://a", None), (109, "B", "b1", None), (110, "L", "  ", None), (111, "L", "9" * 45, None), (112, "L", "7", None)]


def made(spark, triples, terms=TERMS, attrs=ATTRS):
    t = spark.createDataFrame(triples, "s long, p long, o long").selectExpr("*", "1 AS lex", "2 AS slot", "3 AS rng", "4 AS attr")
    d = spark.createDataFrame(terms, "id long, kind string, lex string, lang string").selectExpr("*", "5 AS s", "6 AS slot")
    a = spark.createDataFrame(attrs, "p long, attr string, col_type string").selectExpr("*", "7 AS slot")
    return wide_table(t, d, a)[0]


def test_typed_cells(spark):
    triples = [(1, 1, 100), (1, 1, 100), (1, 2, 112), (1, 3, 102), (1, 4, 103), (1, 5, 104), (1, 6, 105), (1, 6, 106), (1, 7, 107), (1, 8, 108), (1, 9, 101)]
    triples += [(2, 1, 101), (2, 8, 101), (2, 9, 110), (2, 6, 106), (3, 1, 111), (3, 8, 109), (None, 1, 100), (4, None, 100), (5, 1, None), (6, 77, 100), (7, 1, 999)]
    got = {r["s"]: r.asDict() for r in made(spark, triples).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7]
    one = got[1]
    assert one["n"] == Decimal(12) and one["d"] == Decimal("1.5") and one["f"] == float("-inf") and one["b"] is False
    assert one["day"] == dt.date(2024, 2, 29) and one["at"] == dt.datetime(2024, 1, 2) and one["link"] == "http://a" and one["s_2"] == "x"
    assert sorted(one["filled"]) == ["at", "b", "d", "day", "f", "link", "n", "s"]
    assert got[2]["filled"] == [] and got[6]["filled"] == [] and got[7]["filled"] == []
    assert got[3]["n"] is None and sorted(got[3]["filled"]) == ["link", "n"]


def test_empty_tables(spark):
    assert made(spark, []).count() == 0
    assert [tuple(r) for r in made(spark, [(1, 1, 100)], attrs=[]).collect()] == [(1, [])]
    assert [r["filled"] for r in made(spark, [(1, 1, 100)], terms=[]).collect()] == [[]]


def test_faulty_attributes(spark):
    with pytest.raises(ValueError):
        made(spark, [], attrs=[(1, "a", "integer"), (2, "a", "date")])
    with pytest.raises(ValueError):
        made(spark, [], attrs=[(1, "a", "colour")])
    got = made(spark, [(1, 1, 101), (1, 2, 100), (1, None, 100)], attrs=[(1, "a", "string"), (2, "A", "string"), (None, "x", "string")])
    assert sorted(got.columns) == ["A", "a_2", "filled", "s"]


def test_more_subjects_than_a_range(spark):
    from pyspark.sql import functions as F

    n = 70_000
    triples = spark.range(n).select((F.col("id") * 3).alias("s"), F.lit(1).cast("long").alias("p"), (F.col("id") % 100).alias("o"))
    terms = spark.range(100).select("id", F.lit("L").alias("kind"), F.col("id").cast("string").alias("lex"))
    attrs = spark.createDataFrame([(1, "n", "integer")], "p long, attr string, col_type string")
    got = wide_table(triples, terms, attrs)[0]
    assert got.count() == n
    assert got.where(F.col("n") != (F.col("s") / 3) % 100).count() == 0 and got.where("n IS NULL").count() == 0


def test_ordinals(spark):
    df = spark.createDataFrame([(x,) for x in [5, 3, 3, None, 9, -1]], "k long")
    assert sorted(tuple(r) for r in ordinals(df, "k").collect()) == [(-1, 0), (3, 1), (5, 2), (9, 3)]
    assert ordinals(df.where("false"), "k").count() == 0
    assert sorted(r["ordinal"] for r in ordinals(spark.range(1000).repartition(7), "id").collect()) == list(range(1000))


@pytest.mark.parametrize("n", [300, 1500])
def test_many_attributes(spark, n):
    attrs = [(i, f"a{i}", ["integer", "string", "date", "double"][i % 4]) for i in range(n)]
    terms = [(1, "L", "7"), (2, "L", "2024-01-02"), (3, "I", "x")]
    triples = [(1, i, 1 + i % 2) for i in range(n)] + [(2, n - 1, 1)]
    wide, names = wide_table(spark.createDataFrame(triples, "s long, p long, o long"), spark.createDataFrame(terms, "id long, kind string, lex string"), spark.createDataFrame(attrs, "p long, attr string, col_type string"))
    got = {r["s"]: r["filled"] for r in wide.select("s", "filled").collect()}
    fits = {"integer": "1", "string": "12", "date": "2", "double": "1"}
    assert len(names) == n and got[2] == [f"a{n - 1}"]
    assert sorted(got[1]) == sorted(a for i, a, t in attrs if str(1 + i % 2) in fits[t])


def test_ranges(spark):
    from pyspark.sql import functions as F

    triples = spark.range(5000).select((F.col("id") * 7 % 5000).alias("s"), F.lit(1).cast("long").alias("p"), F.col("id").alias("o"))
    terms = spark.range(5000).select("id", F.lit("L").alias("kind"), F.col("id").cast("string").alias("lex"))
    wide, _ = wide_table(triples, terms, spark.createDataFrame([(1, "n", "integer")], "p long, attr string, col_type string"))
    assert wide.where((F.col("n") * 7) % 5000 != F.col("s")).count() == 0 and wide.where("n IS NOT NULL").count() == 5000
