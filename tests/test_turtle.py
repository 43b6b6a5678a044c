import pytest

from tripleloom.functions.xsd import RDF, XSD
from tripleloom.sources.turtle import Turtle, read_turtle


def I(x):  # noqa: E743
    return ("I", x, "", "")


def L(x, lang="", dt=""):
    return ("L", x, lang, dt)


def read(text):
    return list(Turtle(text, "f_"))


def test_prefixes_lists_and_literals():
    got = read("""@base <http://b/> . @prefix : <http://e/> . PREFIX p: <v#>
:s a p:C ; p:q "a"@en-GB , 'b' , \"\"\"long "x" \n\"\"\" , 1 , -1.5 , 2E3 , true , "\\u00E9\\t"^^p:t ; .
<rel> p:r :o.""")
    p = I("http://b/v#q")
    s = I("http://e/s")
    assert got == [
        (s, I(RDF + "type"), I("http://b/v#C")), (s, p, L("a", "en-GB")), (s, p, L("b")), (s, p, L('long "x" \n')), (s, p, L("1", dt=XSD + "integer")), (s, p, L("-1.5", dt=XSD + "decimal")),
        (s, p, L("2E3", dt=XSD + "double")), (s, p, L("true", dt=XSD + "boolean")), (s, p, L("é\t", dt="http://b/v#t")), (I("http://b/rel"), I("http://b/v#r"), I("http://e/o")),
    ]


def test_blank_nodes_and_collections():
    got = read("@prefix : <http://e/> . _:a :p [ :q _:a ; :r [] ] . [ :x 1 ] . [] :y ( 1 :z ) . :e :f () .")
    assert (("B", "f_a", "", ""), I("http://e/p"), ("B", "f_g1", "", "")) in got
    rest = [t for t in got if t[1][1] == RDF + "rest"]
    assert len(rest) == 2 and any(t[2] == I(RDF + "nil") for t in rest)
    assert (I("http://e/e"), I("http://e/f"), I(RDF + "nil")) in got


def test_recovery_goes_on_in_the_next_line():
    got = read("<http://a/s> <http://a/p> <http://a/o> .\n<http://a/s> <http://a/p> .\n<http://a/s> nope:x 1 .\n<http://a/s> <http://a/p> 2 .\n\"\\q\" broken")
    assert [isinstance(g, str) for g in got] == [False, True, True, False, True]


@pytest.mark.parametrize("text", ["", "   \n# only a comment", "@prefix a: <http://x/> ."])
def test_nothing(text):
    assert read(text) == []


def test_reader(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("@prefix e: <http://e/> .\ne:a e:p _:x .\nbad\n")
    (tmp_path / "b.n3").write_text("<http://e/a> <http://e/p> _:x .")
    (tmp_path / "c.txt").write_text("ignored")
    rows = read_turtle(spark, f"file://{tmp_path}").collect()
    good = [r for r in rows if r["corrupt"] is None]
    assert len(rows) == 3 and len(good) == 2
    assert len({r["o"]["lex"] for r in good}) == 2  # labels are scoped to a file


def test_lines_are_taken_as_needed(monkeypatch):
    from tripleloom.sources import turtle

    monkeypatch.setattr(turtle, "CHUNK", 1000)
    taken, held = 0, 0

    def lines():
        nonlocal taken
        yield "@prefix : <http://e/> .\n"
        for taken in range(1, 5001):
            yield f':s :p """a\n' if taken % 2 else f'{taken}""" . # end\n'

    parser = Turtle("", more=lines())
    for n, (_, _, o) in enumerate(parser, 1):
        assert o == L(f"a\n{2 * n}") and taken <= 2 * n + 200
        held = max(held, len(parser.text))
    assert n == 2500 and held < 5000


def test_files_in_many_splits(spark, tmp_path):
    text = "@prefix e: <http://e/> .\r\n" + "".join(
        f'@base <http://b{i}/> .\n_:x{i} e:p """one "{i}"\n\n. two""" , "{"é" * (i % 50)}" ;\n  e:q ( <r> [ e:r {i} ] ) .\ne:bad e:p "open\n' + ('<a> <b> """c\\\n' if i == 350 else f"<s> nope:x {i} .\n" if i % 7 == 0 else "") for i in range(400)
    )
    (tmp_path / "a.ttl").write_text(text, newline="")
    (tmp_path / "b.ttl").write_text("@prefix e: <http://c/> . e:a e:b e:c .", newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = read_turtle(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    own = [r for r in rows if r["file_name"].endswith("/a.ttl")]
    scope = next(r["s"]["lex"] for r in own if r["s"] and r["s"]["kind"] == "B").split("_")[0] + "_"
    want = list(Turtle(text, scope))
    assert [tuple(r["o"]) for r in rows if r not in own] == [I("http://c/c")]
    assert sorted(r["corrupt"] for r in own if r["corrupt"]) == sorted(x for x in want if isinstance(x, str))
    assert sorted(tuple(map(tuple, r[:3])) for r in own if not r["corrupt"]) == sorted(x for x in want if not isinstance(x, str))


def test_registered_query_parses_files_once(spark):
    from tripleloom.source_catalog import QUERIES

    df = QUERIES["turtle_terms"](spark, "/root/testdata/sf0.001")
    assert "MapIn" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count()
