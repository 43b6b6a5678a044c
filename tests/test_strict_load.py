import pytest

from tripleloom.operators.strict_load import strict_load

XSD = "http://www.w3.org/2001/XMLSchema#"
GOOD = [
    "<http://a/s> <http://a/p> <http://a/o> .",
    "<http://a/s><http://a/p><http://a/o>.",
    ' \t<http://a/s> <http://a/p> "x \\" \\u00E9 \\U0001F30A" . # comment',
    '_:b1 <http://a/p> "a"@en-GB-x1 .\r',
    "_:b.1 <http://a/p> _:b2.",
    '<http://a/s> <http://a/p> ""^^<http://a/any> .',
    f'<http://a/s> <http://a/p> "2024-02-29T23:59:59.5-14:00"^^<{XSD}dateTime> .',
    f'<http://a/s> <http://a/p> "-INF"^^<{XSD}double> .',
    f'<http://a/s> <http://a/p> "+.5"^^<{XSD}decimal> .',
    f'<http://a/s> <http://a/p> "\\u0035"^^<{XSD}integer> .',
    "<http://a/\\u00E9> <http://a/p> <urn:x> .",
]
BAD = [
    "<a> <http://a/p> <http://a/o> .",
    "<http://a/s> <http://a/p> <http://a/o>",
    "<http://a/s> <http://a/p> .",
    "<http://a/s> _:p <http://a/o> .",
    '"x" <http://a/p> <http://a/o> .',
    '<http://a/s> <http://a/p> "x .',
    '<http://a/s> <http://a/p> "x\\q" .',
    '<http://a/s> <http://a/p> "\\uD83C" .',
    '<http://a/s> <http://a/p> "\\U00110000" .',
    '<http://a/s> <http://a/p> "x"@en_US .',
    '<http://a/s> <http://a/p> "x"^^<integer> .',
    '<http://a/s> <http://a/p> "x"^<http://a/t> .',
    "<http://a/s> <http://a/p> <http://a/o> . rest",
    "<http://a/s> <http://a/p> <http://a/o> <http://a/g> .",
    "<http://a/s> <http://a/p> <http://a/o o> .",
    f'<http://a/s> <http://a/p> "2023-02-29"^^<{XSD}date> .',
    f'<http://a/s> <http://a/p> "1900-02-29"^^<{XSD}date> .',
    f'<http://a/s> <http://a/p> "2023-04-31"^^<{XSD}date> .',
    f'<http://a/s> <http://a/p> "2023-04-30+14:01"^^<{XSD}date> .',
    f'<http://a/s> <http://a/p> "TRUE"^^<{XSD}boolean> .',
    f'<http://a/s> <http://a/p> " 5"^^<{XSD}integer> .',
    f'<http://a/s> <http://a/p> "1e5"^^<{XSD}decimal> .',
    f'<http://a/s> <http://a/p> "Infinity"^^<{XSD}float> .',
    f'<http://a/s> <http://a/p> "2023-01-01T24:00:01"^^<{XSD}dateTime> .',
]
NOTHING = [None, "", "   ", "\r", "# x", "  # <http://a/s> <http://a/p> <http://a/o> ."]


def test_good_bad_and_nothing(spark):
    rows = [(i, x) for i, x in enumerate(GOOD + BAD + NOTHING)]
    got = strict_load(spark.createDataFrame(rows, "line_id long, stmt string"))
    assert sorted(r[0] for r in got.valid.select("line_id").collect()) == list(range(len(GOOD)))
    failed = {r["line_id"]: r["reason"] for r in got.failed.collect()}
    assert sorted(failed) == list(range(len(GOOD), len(GOOD) + len(BAD)))
    assert all(failed.values())
    assert "lexical space of date" in failed[len(GOOD) + 15]


def test_terms_are_unescaped(spark):
    rows = [(1, GOOD[2]), (2, GOOD[9]), (3, GOOD[10]), (4, GOOD[3]), (5, GOOD[5])]
    got = {r["line_id"]: r for r in strict_load(spark.createDataFrame(rows, "line_id long, stmt string")).valid.collect()}
    assert got[1]["o_lex"] == 'x " é \U0001f30a' and got[1]["o_kind"] == "L"
    assert got[2]["o_lex"] == "5" and got[3]["s_lex"] == "http://a/é"
    assert (got[4]["s_kind"], got[4]["s_lex"], got[4]["o_lang"]) == ("B", "b1", "en-GB-x1")
    assert got[5]["o_lex"] == "" and got[5]["o_dt"] == "http://a/any"


def test_repeats_null_offsets_and_clashing_columns(spark):
    rows = [(None, GOOD[0], "z"), (None, BAD[0], "z"), (7, GOOD[0], "z"), (7, BAD[1], "z"), (7, BAD[1], "z")]
    df = spark.createDataFrame(rows, "line_id long, stmt string, reason string").selectExpr("*", "1 AS well_formed", "2 AS _text", "3 AS s_lex")
    got = strict_load(df)
    assert sorted((r[0] or 0) for r in got.valid.select("line_id").collect()) == [0, 7]
    assert sorted((r[0] or 0) for r in got.failed.select("line_id").collect()) == [0, 7, 7]


def test_very_long_text_and_empty_table(spark):
    long = '<http://a/s> <http://a/p> "' + "\\n é" * 200_000 + '" .'
    got = strict_load(spark.createDataFrame([(1, long), (2, long[:-3])], "line_id long, stmt string"))
    assert [r[0] for r in got.valid.select("line_id").collect()] == [1]
    assert [r["reason"] for r in got.failed.collect()] == ["string isn't closed"]
    none = strict_load(spark.createDataFrame([], "line_id long, stmt string"))
    assert none.valid.count() == none.failed.count() == 0


@pytest.mark.parametrize("year,leap", [("2000", True), ("1900", False), ("2024", True), ("2023", False), ("12024", True), ("-0004", True), ("0000", True), ("2400", True), ("2100", False)])
def test_leap_years(spark, year, leap):
    from pyspark.sql import functions as F

    from tripleloom.functions.xsd import in_lexical_space

    assert spark.range(1).select(in_lexical_space(F.lit(f"{year}-02-29"), "date")).first()[0] is leap
