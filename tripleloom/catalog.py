"""Queries of the core library and the SQL that their results are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.xsd import LEXICAL, XSD
from tripleloom.operators.compaction import compact, compacted
from tripleloom.operators.key_profile import hot_keys, key_profile
from tripleloom.operators.strict_load import strict_load
from tripleloom.operators.wide import wide_table
from tripleloom.runtime import read

ROLES = {"s": "s", "p": "p"}
HOT_SHARE = 0.02


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_load(read(spark, sf_dir, "nt_lines")).failed.select("line_id")


def p1_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each failed line with the reason."""
    return strict_load(read(spark, sf_dir, "nt_lines")).failed


def p1_failed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each failed line as it is."""
    return strict_load(read(spark, sf_dir, "nt_lines")).failed.select("line_id", "stmt")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds, tag and datatype of the terms of each good line."""
    return strict_load(read(spark, sf_dir, "nt_lines")).valid.select("line_id", "s_kind", "o_kind", "o_lang", "o_dt")


def p1_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of the good lines."""
    return strict_load(read(spark, sf_dir, "nt_lines")).valid


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hot_keys(read(spark, sf_dir, "triples"), ROLES, "o", HOT_SHARE).select(F.col("role").alias("term_role"), F.col("key").alias("term_id"))


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct objects, most frequent object and quartiles of the objects of each subject and predicate."""
    return key_profile(read(spark, sf_dir, "triples"), ROLES, "o").withColumnsRenamed({"role": "term_role", "key": "term_id"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compact(read(spark, sf_dir, "nt_files"))
    return compacted(done, spark).select("file_id", "line_no")


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the consolidated files."""
    done = compact(read(spark, sf_dir, "nt_files"))
    return compacted(done, spark).select("file_id", "line_no", "record")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, _ = wide_table(read(spark, sf_dir, "triples"), read(spark, sf_dir, "dict"), read(spark, sf_dir, "wide_attrs"))
    return wide.select("s", F.explode("filled").alias("attr"))


def p5_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each subject, one typed column for each attribute."""
    wide, _ = wide_table(read(spark, sf_dir, "triples"), read(spark, sf_dir, "dict"), read(spark, sf_dir, "wide_attrs"))
    return wide.drop("filled")


def p5_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed cells of the wide table: numbers, truth values, days and seconds as numbers, the others as texts."""
    wide, names = wide_table(read(spark, sf_dir, "triples"), read(spark, sf_dir, "dict"), read(spark, sf_dir, "wide_attrs"))
    cells = []
    for a in names:
        c = F.col(f"`{a.column}`")
        number = {"string": F.lit(None), "iri": F.lit(None), "date": F.unix_date(c), "datetime": F.unix_micros(c) / 1e6}.get(a.col_type, c).cast("double")
        cells.append(F.struct(F.lit(a.name).alias("attr"), number.alias("number"), (c if a.col_type in ("string", "iri") else F.lit(None)).cast("string").alias("text")))
    return wide.select("s", F.inline(F.array(*cells))).where("number IS NOT NULL OR text IS NOT NULL")


def _sql_pattern(name: str) -> str:
    """The lexical pattern without look-ahead, for SQL."""
    return LEXICAL[name].replace(r"(?=-?(?:[1-9][0-9]{3,}|0[0-9]{3})-)", "").replace(r"\z", "$")


def _case(lex: str) -> str:
    fits = " ".join(f"WHEN '{t}' THEN d.kind = 'L' AND regexp_matches({lex}, '{_sql_pattern('dateTime' if t == 'datetime' else t)}')" for t in ("integer", "decimal", "double", "boolean", "date", "datetime"))
    return f"CASE w.col_type {fits} WHEN 'string' THEN d.kind = 'L' AND {lex} <> '' WHEN 'iri' THEN d.kind IN ('I', 'B') END"


_LEX = "trim(d.lex, E' \\t\\n\\r')"
_FITTING = f"FROM triples t JOIN wide_attrs w ON t.p = w.p JOIN dict d ON t.o = d.id WHERE t.s IS NOT NULL AND {_case(_LEX)}"
_NUMBER = """CASE col_type WHEN 'integer' THEN CAST(TRY_CAST(x AS DECIMAL(38, 0)) AS DOUBLE) WHEN 'decimal' THEN CAST(TRY_CAST(x AS DECIMAL(38, 18)) AS DOUBLE) WHEN 'double' THEN TRY_CAST(x AS DOUBLE)
 WHEN 'boolean' THEN CASE WHEN x IN ('true', '1') THEN 1 ELSE 0 END WHEN 'date' THEN CAST(CAST(x[1:10] AS DATE) - DATE '1970-01-01' AS DOUBLE)
 WHEN 'datetime' THEN epoch_us(CAST(CASE WHEN regexp_matches(x, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN replace(x, 'T24:', 'T00:') ELSE replace(x, 'T24:', 'T00:') || 'Z' END AS TIMESTAMPTZ)) / 1e6 + CASE WHEN x LIKE '%T24:%' THEN 86400 ELSE 0 END END"""
_LINES = "SELECT file_id, generate_subscripts(string_split(body, chr(10)), 1) AS line_no, trim(unnest(string_split(body, chr(10))), E' \\t\\r\\n') AS record FROM nt_files"
_PLACES = f"SELECT record, min({{'f': file_id, 'l': line_no}}) AS m FROM ({_LINES}) WHERE record <> '' AND record NOT LIKE '#%' GROUP BY record"
_BMP = r"(?:[0-9A-Ca-cEFef][0-9A-Fa-f]{3}|[Dd][0-7][0-9A-Fa-f]{2})"
_ESC = rf"\\u{_BMP}|\\U0000{_BMP}|\\U000[1-9A-Fa-f][0-9A-Fa-f]{{4}}|\\U0010[0-9A-Fa-f]{{4}}"
_IRI = rf"<[A-Za-z][A-Za-z0-9+.-]*:(?:[^\x00-\x20<>\"{{}}|^`\\]|{_ESC})*>"
_BLANK = r"_:[\p{L}0-9_:](?:[\p{L}0-9_:.-]*[\p{L}0-9_:-])?"
_STR = rf"\"((?:[^\"\\\n\r]|\\[tbnrf\"'\\]|{_ESC})*)\"".replace("'", "''")
_STMT = rf"^[ \t]*(?:{_IRI}|{_BLANK})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BLANK}|{_STR}(?:[ \t]*\^\^[ \t]*<([^>]*)>|[ \t]*@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)?)[ \t]*\.[ \t]*(?:#[^\n\r]*)?\r?$"
_P1_BAD = " OR ".join(f"(t = '{XSD}{n}' AND NOT regexp_matches(v, '{_sql_pattern(n)}'))" for n in LEXICAL)
_P1 = f"""WITH l AS (SELECT line_id, stmt, regexp_matches(stmt, '{_STMT}') AS ok, regexp_extract(stmt, '{_STMT}', 1) AS v, regexp_extract(stmt, '{_STMT}', 2) AS t
  FROM nt_lines WHERE stmt IS NOT NULL AND NOT regexp_matches(stmt, '^\\s*(#.*)?$'))
SELECT line_id FROM l WHERE NOT ok OR ({_P1_BAD})"""
_KIND_STMT = rf"^[ \t]*(?:{_IRI}|({_BLANK}))[ \t]*{_IRI}[ \t]*(?:({_IRI})|({_BLANK})|{_STR}(?:[ \t]*\^\^[ \t]*<([^>]*)>|[ \t]*@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*))?)[ \t]*\.[ \t]*(?:#[^\n\r]*)?\r?$"
_GROUP = [f"regexp_extract(stmt, '{_KIND_STMT}', {i})" for i in range(7)]
_P1_KINDS = f"""WITH l AS (SELECT line_id, {_GROUP[1]} AS b, {_GROUP[2]} AS i, {_GROUP[3]} AS ob, {_GROUP[4]} AS v, {_GROUP[5]} AS t, {_GROUP[6]} AS g
  FROM nt_lines WHERE regexp_matches(stmt, '{_STMT}'))
SELECT line_id, CASE WHEN b <> '' THEN 'B' ELSE 'I' END AS s_kind, CASE WHEN i <> '' THEN 'I' WHEN ob <> '' THEN 'B' ELSE 'L' END AS o_kind, nullif(g, '') AS o_lang, nullif(t, '') AS o_dt FROM l WHERE NOT ({_P1_BAD})"""

SQL = {
    "p1_found": _P1,
    "p1_failed_lines": _P1.replace("SELECT line_id FROM l", "SELECT line_id, stmt FROM l"),
    "p1_kinds": _P1_KINDS,
    "p2_found": f"""SELECT 's' AS term_role, s AS term_id FROM triples WHERE s IS NOT NULL GROUP BY s HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM triples)
UNION ALL SELECT 'p', p FROM triples WHERE p IS NOT NULL GROUP BY p HAVING count(*) >= {HOT_SHARE} * (SELECT count(*) FROM triples)""",
    "p2_profile": " UNION ALL ".join(
        f"""SELECT t.*, m.o AS mode, m.w AS mode_rows FROM (SELECT '{r}' AS term_role, {r} AS term_id, count(*) AS n_rows, count(DISTINCT o) AS n_distinct, quantile_disc(o, 0.25) AS p25, quantile_disc(o, 0.5) AS p50, quantile_disc(o, 0.75) AS p75 FROM triples GROUP BY {r}) t
LEFT JOIN (SELECT {r} AS k, o, w FROM (SELECT {r}, o, count(*) AS w, row_number() OVER (PARTITION BY {r} ORDER BY count(*) DESC, o) AS rk FROM triples WHERE o IS NOT NULL GROUP BY {r}, o) WHERE rk = 1) m ON m.k IS NOT DISTINCT FROM t.term_id"""
        for r in ROLES
    ),
    "p4_found": f"SELECT m.f AS file_id, CAST(m.l AS INTEGER) AS line_no FROM ({_PLACES})",
    "p4_records": f"SELECT m.f AS file_id, CAST(m.l AS INTEGER) AS line_no, record FROM ({_PLACES})",
    "p5_found": f"SELECT DISTINCT t.s, w.attr {_FITTING}",
    "p5_cells": f"SELECT s, attr, {_NUMBER} AS number, CASE WHEN col_type IN ('string', 'iri') THEN x END AS text FROM (SELECT t.s, w.attr, w.col_type, min({_LEX}) AS x {_FITTING} GROUP BY ALL) WHERE number IS NOT NULL OR text IS NOT NULL",
}

QUERIES = {q.__name__: q for q in (p1_found, p1_failures, p1_failed_lines, p1_kinds, p1_triples, p2_found, p2_profile, p4_found, p4_records, p5_found, p5_wide, p5_cells)}
