"""Relational tables as triples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.xsd import RDF, XSD
from tripleloom.runtime import read, spread

BASE = "http://ex.org/"
VOCABULARY = BASE + "v#"


@dataclass(frozen=True)
class Mapping:
    """How a table's rows become subjects: class, subject path and key columns (all columns for rows without a key), and for
    each predicate a column with the path of the object's IRI, or None for a literal."""

    klass: str
    path: str
    key: tuple[str, ...]
    predicates: dict[str, tuple[str, str | None]]
    lang: dict[str, str] | None = None


def _literals(prefix: str, *names: str) -> dict[str, tuple[str, None]]:
    return {n: (f"{prefix}_{n}", None) for n in names}


MAPPINGS = {
    "region": Mapping("Region", "region", ("r_regionkey",), _literals("r", "name")),
    "nation": Mapping("Nation", "nation", ("n_nationkey",), {**_literals("n", "name"), "region": ("n_regionkey", "region")}),
    "customer": Mapping("Customer", "customer", ("c_custkey",), {**_literals("c", "name", "acctbal", "mktsegment"), "nation": ("c_nationkey", "nation")}),
    "supplier": Mapping("Supplier", "supplier", ("s_suppkey",), {**_literals("s", "name", "acctbal"), "nation": ("s_nationkey", "nation")}),
    "part": Mapping("Part", "part", ("p_partkey",), {**_literals("p", "name", "brand", "size", "retailprice"), "ptype": ("p_type", None)}),
    "orders": Mapping("Order", "order", ("o_orderkey",), {"customer": ("o_custkey", "customer"), "status": ("o_orderstatus", None), "totalprice": ("o_totalprice", None), "orderdate": ("o_orderdate", None), "priority": ("o_orderpriority", None)}),
    "lineitem": Mapping("Lineitem", "lineitem", (), {"order": ("l_orderkey", "order"), "part": ("l_partkey", "part"), "supplier": ("l_suppkey", "supplier"), **_literals("l", "linenumber", "quantity", "extendedprice", "discount", "tax", "returnflag", "linestatus", "shipdate")}),
    "events": Mapping("Event", "event", ("event_id",), {"ts": ("ts", None), "user": ("user_id", "user"), "eventtype": ("event_type", None), "value": ("value", None), "props": ("props", None)}),
    "documents": Mapping("Document", "document", ("doc_id",), {"text": ("text", None), "source": ("source", None), "nchars": ("n_chars", None), "paper": ("paper_no", None), "rev": ("rev", None), "shelf": ("shelf_code", None), "submitted": ("submitted_at", None), "fetched": ("fetched_at", None)}, {"text": "lang"}),
}

_DATATYPES = {"int": "integer", "bigint": "integer", "smallint": "integer", "tinyint": "integer", "double": "double", "float": "double", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}


def _node(kind: str, lex: Column, lang: Column | None = None, dt: str = "") -> Column:
    return F.struct(F.lit(kind).alias("kind"), lex.alias("lex"), (F.lit("") if lang is None else lang).alias("lang"), F.lit(dt).alias("dt"))


def _lexical(column: Column, kind: str) -> Column:
    if kind.startswith("timestamp"):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return column.cast("string")


def table_statements(df: DataFrame, m: Mapping) -> DataFrame:
    """Structs s, p, o: the row's class and a statement for each predicate; null columns give none. One pass over the table."""
    key = [F.col(k).cast("string") for k in m.key] or [F.hex(F.xxhash64(*df.columns))]
    subject = _node("I", F.concat_ws("/", F.lit(BASE + m.path), *key))
    kinds = dict(df.dtypes)
    pairs = [F.struct(_node("I", F.lit(RDF + "type")).alias("p"), _node("I", F.lit(VOCABULARY + m.klass)).alias("o"))]
    for name, (column, target) in m.predicates.items():
        kind = kinds[column].split("(")[0]
        dt = XSD + _DATATYPES[kind] if kind in _DATATYPES else ""
        lex = _lexical(F.col(column), kind)
        lang = F.coalesce(F.lower(F.col(m.lang[name])), F.lit("")) if m.lang and name in m.lang else None
        o = _node("I", F.concat(F.lit(f"{BASE}{target}/"), lex)) if target else _node("L", lex, lang, dt)
        pairs.append(F.struct(_node("I", F.lit(VOCABULARY + name)).alias("p"), o.alias("o")))
    rows = spread(df).select(subject.alias("s"), F.explode(F.array(*pairs)).alias("x")).select("s", "x.p", "x.o")
    return rows.where("s.lex IS NOT NULL AND o.lex IS NOT NULL")


def tables_statements(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    out = None
    for n in names:
        part = table_statements(read(spark, sf_dir, n), MAPPINGS[n])
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out
