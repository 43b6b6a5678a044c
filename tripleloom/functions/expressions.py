"""Filter expressions as columns. An error is null, so that Spark's three-valued logic is that of SPARQL filters."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripleloom.functions.terms import Value
from tripleloom.functions.xsd import XSD, bound, decimal_key
from tripleloom.plans.algebra import Call, Term, Var

RDF_LANG_STRING = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"


@dataclass(frozen=True)
class UserFunction:
    """A function that filters call by its IRI. It gets a column for each argument, of the kinds in ``takes``, and gives one
    of the kind ``gives``; kinds are number, text (the lexical form) and flag. The column may come from a pandas UDF."""

    call: Callable[..., Column]
    takes: tuple[str, ...]
    gives: str


def constant(t: Term) -> Value:
    return Value.of_term(F.lit(t.kind), F.lit(t.lex), F.lit(t.lang).cast("string"), F.lit(t.dt).cast("string"))


def _summand(x: Column) -> Column:
    return x.try_cast("decimal(37,18)")


def _factor(x: Column) -> Column:
    """Null where it would round."""
    return bound(x, lambda v: F.when(v.try_cast("decimal(18,9)") == v, v.try_cast("decimal(18,9)")))


class Expressions:
    """Translates expressions. values: the columns of each variable in scope; others are unbound."""

    def __init__(self, values: Mapping[Var, Value], functions: Mapping[str, UserFunction]):
        self.values, self.functions = values, functions

    def condition(self, e: object) -> Column:
        """True where a row passes; false and null don't."""
        return self.value(e).truth()

    def value(self, e: object) -> Value:
        if isinstance(e, Var):
            return self.values.get(e) or Value._literal()
        if isinstance(e, Term):
            return constant(e)
        assert isinstance(e, Call)
        if e.name in self.functions:
            f = self.functions[e.name]
            if len(e.args) != len(f.takes):
                raise ValueError(f"{e.name} takes {len(f.takes)} arguments")
            got = f.call(*(self._as(self.value(a), k) for a, k in zip(e.args, f.takes)))
            return {"number": Value.of_number, "text": Value.of_text, "flag": Value.of_flag}[f.gives](got)
        method = _METHODS.get(e.name)
        if method is None:
            raise ValueError(f"unknown function {e.name}")
        return method(self, *e.args)

    @staticmethod
    def _as(v: Value, kind: str) -> Column:
        return {"number": v.number, "text": v.lex, "flag": v.truth()}[kind]

    def _truth(self, e: object) -> Column:
        return self.value(e).truth()

    def _or(self, a, b) -> Value:
        return Value.of_flag(self._truth(a) | self._truth(b))

    def _and(self, a, b) -> Value:
        return Value.of_flag(self._truth(a) & self._truth(b))

    def _not(self, a) -> Value:
        return Value.of_flag(~self._truth(a))

    def _equal(self, a, b) -> Value:
        return Value.of_flag(self.value(a).equals(self.value(b)))

    def _unequal(self, a, b) -> Value:
        return Value.of_flag(~self.value(a).equals(self.value(b)))

    def _less(self, a, b) -> Value:
        return Value.of_flag(self.value(a).less(self.value(b)))

    def _more(self, a, b) -> Value:
        return Value.of_flag(self.value(b).less(self.value(a)))

    def _at_most(self, a, b) -> Value:
        x, y = self.value(a), self.value(b)
        both = F.coalesce(x.exact <= y.exact, x.digits <= y.digits, x._ieee(y, lambda m, n: m <= n), x.moment <= y.moment, x.flag <= y.flag, x.text <= y.text)
        return Value.of_flag(both)

    def _at_least(self, a, b) -> Value:
        return self._at_most(b, a)

    def _arithmetic(self, a, b, op, exact: Callable[[Column], Column]) -> Value:
        """Exact where both operands fit the type in which the result doesn't round, else by doubles."""
        x, y = self.value(a), self.value(b)
        return Value.of_number(op(x.number, y.number), op(exact(x.exact), exact(y.exact)))

    def _plus(self, a, b) -> Value:
        return self._arithmetic(a, b, F.try_add, _summand)

    def _minus(self, a, b) -> Value:
        return self._arithmetic(a, b, F.try_subtract, _summand)

    def _times(self, a, b) -> Value:
        return self._arithmetic(a, b, F.try_multiply, _factor)

    def _divided(self, a, b) -> Value:
        return self._arithmetic(a, b, F.try_divide, _factor)

    def _positive(self, a) -> Value:
        v = self.value(a)
        return Value.of_number(v.number, v.exact)

    def _negative(self, a) -> Value:
        v = self.value(a)
        turned = F.when(v.lex.startswith("-"), F.substring(v.lex, 2, 1 << 30)).otherwise(F.concat(F.lit("-"), F.regexp_replace(v.lex, r"^\+", "")))
        return replace(Value.of_number(-v.number, -v.exact), digits=F.when(v.digits.isNotNull(), decimal_key(turned)))

    def _str(self, a) -> Value:
        v = self.value(a)
        return Value.of_text(F.when(v.kind != "B", v.lex))

    def _lang(self, a) -> Value:
        v = self.value(a)
        return Value.of_text(F.when(v.kind == "L", F.coalesce(v.lang, F.lit(""))))

    def _lang_matches(self, a, b) -> Value:
        tag, wanted = F.lower(self.value(a).text), F.lower(self.value(b).text)
        return Value.of_flag(F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))))

    def _datatype(self, a) -> Value:
        v = self.value(a)
        return Value.of_iri(F.when(v.kind == "L", F.when(v.lang.isNotNull(), F.lit(RDF_LANG_STRING)).otherwise(F.coalesce(v.dt, F.lit(XSD + "string")))))

    def _bound(self, a) -> Value:
        return Value.of_flag(self.values[a].kind.isNotNull() if a in self.values else F.lit(False))

    def _same_term(self, a, b) -> Value:
        return Value.of_flag(self.value(a).same(self.value(b)))

    def _is_iri(self, a) -> Value:
        return Value.of_flag(self.value(a).kind == "I")

    def _is_blank(self, a) -> Value:
        return Value.of_flag(self.value(a).kind == "B")

    def _is_literal(self, a) -> Value:
        return Value.of_flag(self.value(a).kind == "L")

    def _regex(self, text, pattern, flags=None) -> Value:
        """Patterns may be computed; flags i, s, m, x."""
        t, p = self.value(text), self.value(pattern)
        subject = F.when(t.kind == "L", F.coalesce(t.text, F.when(t.lang.isNotNull(), t.lex)))
        if flags is None:
            return Value.of_flag(F.regexp(subject, p.text))
        f = self.value(flags).text
        return Value.of_flag(F.regexp(subject, F.when(f == "", p.text).otherwise(F.concat(F.lit("(?"), f, F.lit(")"), p.text))))

    def _in(self, x, *items) -> Value:
        """True if one is equal; an error only if none is and one comparison failed."""
        v = self.value(x)
        found = F.lit(False)
        for i in items:
            found = found | v.equals(self.value(i))
        return Value.of_flag(found)


_METHODS: dict[str, Callable] = {
    "||": Expressions._or, "&&": Expressions._and, "!": Expressions._not,
    "=": Expressions._equal, "!=": Expressions._unequal, "<": Expressions._less, ">": Expressions._more, "<=": Expressions._at_most, ">=": Expressions._at_least,
    "+": Expressions._plus, "-": Expressions._minus, "*": Expressions._times, "/": Expressions._divided, "plus": Expressions._positive, "minus": Expressions._negative,
    "str": Expressions._str, "lang": Expressions._lang, "langmatches": Expressions._lang_matches, "datatype": Expressions._datatype, "bound": Expressions._bound,
    "sameterm": Expressions._same_term, "isiri": Expressions._is_iri, "isblank": Expressions._is_blank, "isliteral": Expressions._is_literal, "regex": Expressions._regex, "in": Expressions._in,
}
