"""RDF terms as columns: identifiers, typed views, sort keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.functions.xsd import EXACT, LEXICAL, XSD, decimal_key
from tripleloom.functions.xsd import moment as moment_of

#: Datatypes whose values are whole numbers, all subtypes of decimal.
INTEGERS = ["integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte"]
TERM_FIELDS = ("kind", "lex", "lang", "dt")


def term_id(kind: Column, lex: Column, lang: Column, dt: Column, identity: str = "rdf") -> Column:
    """64-bit identifier. rdf: of kind, text, tag and datatype; lexical: of the text alone. Null parts are made empty, as the
    hash skips nulls; language tags are compared without case."""
    if identity == "lexical":
        return F.xxhash64(F.coalesce(lex, F.lit("")))
    plain = F.when(F.coalesce(dt, F.lit("")) == XSD + "string", F.lit("")).otherwise(F.coalesce(dt, F.lit("")))
    return F.xxhash64(kind, F.coalesce(lex, F.lit("")), F.lower(F.coalesce(lang, F.lit(""))), plain)


def _xsd(*names: str) -> list[str]:
    return [XSD + n for n in names]


@dataclass(frozen=True)
class Value:
    """An expression's value as columns, each null where the value isn't of that kind; all null: an error (or unbound).

    exact holds the integers and decimals that fit DECIMAL(38, 18), digits all of them (a text that compares as they do),
    number all numerics, flag booleans, moment dateTimes, text plain strings. A term also has kind, lex, lang and dt."""

    kind: Column
    lex: Column
    lang: Column
    dt: Column
    exact: Column
    digits: Column
    number: Column
    flag: Column
    moment: Column
    text: Column

    @staticmethod
    def of_term(kind: Column, lex: Column, lang: Column, dt: Column) -> Value:
        dt = F.when(dt == "", F.lit(None)).otherwise(dt)
        lang = F.when(lang == "", F.lit(None)).otherwise(lang)
        literal = kind == "L"
        whole = literal & dt.isin(_xsd(*INTEGERS)) & lex.rlike(LEXICAL["integer"])
        decimal = literal & (dt == XSD + "decimal") & lex.rlike(LEXICAL["decimal"])
        double = literal & dt.isin(_xsd("double", "float")) & lex.rlike(LEXICAL["double"])
        exact = F.when((whole | decimal) & lex.rlike(EXACT), lex.try_cast("decimal(38,18)"))
        digits = F.when(whole | decimal, decimal_key(lex))
        special = F.when(lex == "NaN", F.lit(float("nan"))).when(lex.endswith("INF"), F.when(lex.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        number = F.when(whole | decimal, lex.try_cast("double")).when(double, F.coalesce(special, lex.try_cast("double")))
        flag = F.when(literal & (dt == XSD + "boolean"), F.when(lex.isin("true", "1"), True).when(lex.isin("false", "0"), False))
        moment = F.when(literal & (dt == XSD + "dateTime") & lex.rlike(LEXICAL["dateTime"]), moment_of(lex))
        text = F.when(literal & lang.isNull() & (dt.isNull() | (dt == XSD + "string")), lex)
        return Value(kind, lex, lang, dt, exact, digits, number, flag, moment, text)

    @staticmethod
    def _literal(**known: Column) -> Value:
        none = {"exact": "decimal(38,18)", "digits": "string", "number": "double", "flag": "boolean", "moment": "timestamp", "text": "string", "lex": "string", "lang": "string", "dt": "string"}
        got = {k: known[k] if k in known else F.lit(None).cast(t) for k, t in none.items()}
        return Value(kind=F.when(got["lex"].isNotNull(), F.lit("L")), **got)

    @staticmethod
    def of_number(number: Column, exact: Column | None = None) -> Value:
        exact = F.lit(None).cast("decimal(38,18)") if exact is None else exact.try_cast("decimal(38,18)")
        lex = F.coalesce(F.regexp_replace(exact.cast("string"), r"\.?0+$", ""), number.cast("string"))
        return Value._literal(number=number, exact=exact, digits=decimal_key(exact.cast("string")), lex=lex, dt=F.when(exact.isNotNull(), F.lit(XSD + "decimal")).when(number.isNotNull(), F.lit(XSD + "double")))

    @staticmethod
    def of_flag(flag: Column) -> Value:
        return Value._literal(flag=flag, lex=flag.cast("string"), dt=F.when(flag.isNotNull(), F.lit(XSD + "boolean")))

    @staticmethod
    def of_text(text: Column) -> Value:
        return Value._literal(text=text, lex=text)

    @staticmethod
    def of_iri(lex: Column) -> Value:
        v = Value._literal(lex=lex)
        return Value(F.when(lex.isNotNull(), F.lit("I")), *(getattr(v, n) for n in ("lex", "lang", "dt", "exact", "digits", "number", "flag", "moment", "text")))

    def truth(self) -> Column:
        """Effective boolean value; null is an error."""
        return F.coalesce(self.flag, (self.number != 0) & ~F.isnan(self.number), F.length(self.text) > 0)

    def same(self, other: Value) -> Column:
        """sameTerm."""
        part = lambda c: F.coalesce(c, F.lit(""))
        plain = lambda c: F.when(part(c) == XSD + "string", F.lit("")).otherwise(part(c))
        return (self.kind == other.kind) & (self.lex == other.lex) & (F.lower(part(self.lang)) == F.lower(part(other.lang))) & (plain(self.dt) == plain(other.dt))

    def equals(self, other: Value) -> Column:
        return F.coalesce(self.exact == other.exact, self.digits == other.digits, self._ieee(other, lambda a, b: a == b), self.moment == other.moment, self.flag == other.flag, self.same(other))

    def _ieee(self, other: Value, test) -> Column:
        """Numbers compared as IEEE has it, where NaN is neither equal to nor less than anything."""
        a, b = self.number, other.number
        return F.when(a.isNotNull() & b.isNotNull(), ~F.isnan(a) & ~F.isnan(b) & test(a, b))

    def less(self, other: Value) -> Column:
        return F.coalesce(self.exact < other.exact, self.digits < other.digits, self._ieee(other, lambda a, b: a < b), self.moment < other.moment, self.flag < other.flag, self.text < other.text)

    def sort_key(self) -> list[Column]:
        """SPARQL order: unbound, blank nodes, IRIs, literals; numbers by value before the other literals, these by text."""
        rank = F.when(self.kind.isNull(), 0).when(self.kind == "B", 1).when(self.kind == "I", 2).when(self.number.isNotNull(), 3).otherwise(4)
        return [rank, self.number, self.digits, self.moment, self.lex, F.coalesce(self.lang, F.lit("")), F.coalesce(self.dt, F.lit(""))]
