"""Random terms written and read again, by both readers."""

import random

from pyspark.sql import functions as F

from tripleloom.functions.terms import TERM_FIELDS, term_id
from tripleloom.sources.ntriples import parsed, to_ntriples
from tripleloom.sources.turtle import Turtle

XSD = "http://www.w3.org/2001/XMLSchema#"


def texts(n, seed=0):
    rng = random.Random(seed)
    alphabet = list("ab \"\\'<>@^.#\n\r\t_:{}|$") + ["\\n", "\u00e9", "\u0301", "\u2028", "\U0001f30a", "\x01", "\x7f", "\ufeff"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(n)] + ["", "x" * 100_000, "\\" * 5000, '"' * 5000]


def literals():
    rng = random.Random(1)
    return [(i, t, *rng.choice([(None, None), ("en-GB", None), (None, XSD + "string"), (None, "http://a/t")])) for i, t in enumerate(texts(300))]


def test_literals_survive_ntriples(spark):
    rows = literals()
    df = spark.createDataFrame(rows, "i long, lex string, lang string, dt string")
    term = to_ntriples(F.lit("L"), F.col("lex"), F.col("lang"), F.col("dt"))
    lines = df.select("i", F.concat(F.lit("<h:s> <h:p> "), term, F.lit(" .")).alias("stmt"))
    got = {r["i"]: (r["o_lex"], r["o_lang"], r["o_dt"]) for r in parsed(lines, "stmt", ["i"]).where("well_formed").collect()}
    assert got == {i: (lex, lang, dt) for i, lex, lang, dt in rows}
    by_turtle = {}
    for r in lines.collect():
        ((_, _, (kind, lex, lang, dt)),) = list(Turtle(r["stmt"]))
        by_turtle[r["i"]] = (lex, lang or None, dt or None)
    assert by_turtle == got


def test_ids_tell_terms_apart(spark):
    rows = [(k, t, lang, dt) for t in texts(60, 2) for k, lang, dt in (("I", None, None), ("B", None, None), ("L", None, None), ("L", "en", None), ("L", None, "en"), ("L", None, "h:t"))]
    rows = sorted(set(rows), key=repr)
    df = spark.createDataFrame(rows, "kind string, lex string, lang string, dt string")
    ids = [r[0] for r in df.select(term_id(*(F.col(c) for c in TERM_FIELDS))).collect()]
    assert len(set(ids)) == len(rows)
    same = spark.createDataFrame([("L", "x", "EN", None), ("L", "x", "en", ""), ("L", "y", None, XSD + "string"), ("L", "y", "", None)], df.schema)
    got = [r[0] for r in same.select(term_id(*(F.col(c) for c in TERM_FIELDS))).collect()]
    assert got[0] == got[1] and got[2] == got[3]
    assert df.select(term_id(*(F.col(c) for c in TERM_FIELDS), "lexical")).distinct().count() == len({r[1] for r in rows})
