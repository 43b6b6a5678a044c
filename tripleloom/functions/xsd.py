"""Lexical spaces of XML Schema datatypes as regular expressions (Java and Python alike), calendar rules included."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

_YEAR = r"-?(?:[1-9][0-9]{3,}|0[0-9]{3})"
_MONTH_DAY = r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))"
#: Divisible by 4 and not by 100, or by 400.
_LEAP = r"(?:[0-9]{2,}(?:0[48]|[2468][048]|[13579][26])|[0-9]*(?:[02468][048]|[13579][26])00)"
_ZONE = r"(?:Z|[+-](?:(?:0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_DAY = rf"(?:{_YEAR}-{_MONTH_DAY}|(?={_YEAR}-)-?{_LEAP}-02-29)"
_TIME = r"(?:(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"

#: Whole-string patterns by local name.
LEXICAL = {
    "integer": r"^[+-]?[0-9]+\z",
    "decimal": rf"^{_NUMBER}\z",
    "double": rf"^(?:{_NUMBER}(?:[eE][+-]?[0-9]+)?|[+-]?INF|NaN)\z",
    "boolean": r"^(?:true|false|1|0)\z",
    "date": rf"^{_DAY}{_ZONE}\z",
    "dateTime": rf"^{_DAY}T{_TIME}{_ZONE}\z",
}
LEXICAL["float"] = LEXICAL["double"]


def in_lexical_space(lex: Column, local_name: str) -> Column:
    """True, false, or null for a null text."""
    return lex.rlike(LEXICAL[local_name])


def moment(lex: Column) -> Column:
    """The time of a conforming dateTime: UTC where there's no zone, fractions cut to microseconds, 24:00:00 the next day's start."""
    text = F.regexp_replace(F.regexp_replace(lex, r"T24:00:00(?:\.0+)?", "T00:00:00"), r"(\.[0-9]{6})[0-9]+", "$1")
    stamp = text.try_cast("timestamp")
    return F.when(lex.contains("T24:00:00"), stamp + F.expr("INTERVAL 1 DAY")).otherwise(stamp)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once: expressions that mention it several times don't grow when they are nested."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decimal_key(lex: Column) -> Column:
    """A text for each conforming integer or decimal that compares as its value does, however many digits it has: sign, number of
    whole digits, digits; for negative numbers with each digit replaced by what it lacks to 9 and a closing sign above all."""

    def key(x: Column) -> Column:
        body = F.regexp_replace(x, "^[+-]", "")
        whole = F.regexp_replace(F.substring_index(body, ".", 1), "^0+", "")
        rest = F.when(body.contains("."), F.regexp_replace(F.substring_index(body, ".", -1), "0+$", "")).otherwise("")
        size = F.concat(F.lpad(F.length(whole).cast("string"), 10, "0"), whole, F.lit("."), rest)
        return F.when((whole == "") & (rest == ""), "1").when(x.startswith("-"), F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))).otherwise(F.concat(F.lit("2"), size))

    return bound(lex, key)


#: Texts of decimals that DECIMAL(38, 18) holds exactly.
EXACT = r"^[+-]?0*[0-9]{0,20}(?:\.[0-9]{0,18}0*)?\z"


def typed(lex: Column, col_type: str) -> Column:
    """The value of a conforming text, else null. Values beyond the Spark type's range are null as well.

    integer DECIMAL(38,0), decimal DECIMAL(38,18) (null where that would round), double DOUBLE, boolean BOOLEAN, date DATE (the zone is left out),
    datetime TIMESTAMP (UTC where there's no zone; fractions are cut to microseconds), string and iri STRING."""
    if col_type in ("string", "iri"):
        return lex
    name = "dateTime" if col_type == "datetime" else col_type
    ok = in_lexical_space(lex, name)
    if col_type == "double":
        value = F.when(lex.rlike("INF$"), F.when(lex.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(lex == "NaN", F.lit(float("nan"))).otherwise(lex.try_cast("double"))
    elif col_type == "date":
        value = F.regexp_extract(lex, r"^(-?[0-9]+-[0-9]{2}-[0-9]{2})", 1).try_cast("date")
    elif col_type == "datetime":
        value = moment(lex)
    elif col_type == "decimal":
        value = F.when(lex.rlike(EXACT), lex.try_cast("decimal(38,18)"))
    else:
        value = lex.try_cast({"integer": "decimal(38,0)", "boolean": "boolean"}[col_type])
    return F.when(ok, value)


SPARK_TYPE = {"string": "string", "iri": "string", "integer": "decimal(38,0)", "decimal": "decimal(38,18)", "double": "double", "boolean": "boolean", "date": "date", "datetime": "timestamp"}
