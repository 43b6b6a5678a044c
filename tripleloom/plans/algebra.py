"""Parsed queries: terms, patterns, groups and expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from tripleloom.functions.xsd import XSD


@dataclass(frozen=True)
class Var:
    """A variable; hidden ones stand for blank nodes of a pattern and can't be selected."""

    name: str
    hidden: bool = False


@dataclass(frozen=True)
class Term:
    """A constant: kind I, B or L; lang and dt only for literals."""

    kind: str
    lex: str
    lang: str | None = None
    dt: str | None = None


@dataclass(frozen=True)
class Pattern:
    s: Var | Term
    p: Var | Term
    o: Var | Term

    @property
    def variables(self) -> tuple[Var, ...]:
        return tuple(dict.fromkeys(t for t in (self.s, self.p, self.o) if isinstance(t, Var)))


@dataclass(frozen=True)
class Call:
    """An operator or function of an expression by its name; custom functions have their IRI as the name."""

    name: str
    args: tuple[object, ...]


@dataclass(frozen=True)
class TableCall:
    """A table function: name, input expressions, output variables."""

    name: str
    inputs: tuple[object, ...]
    outputs: tuple[Var, ...]


@dataclass
class Group:
    patterns: list[Pattern] = field(default_factory=list)
    filters: list[object] = field(default_factory=list)
    tables: list[TableCall] = field(default_factory=list)
    unions: list[list[Group]] = field(default_factory=list)
    optionals: list[Group] = field(default_factory=list)

    def variables(self) -> list[Var]:
        out = [v for p in self.patterns for v in p.variables]
        out += [v for u in self.unions for g in u for v in g.variables()]
        out += [v for g in self.optionals for v in g.variables()]
        out += [v for t in self.tables for v in t.outputs]
        return list(dict.fromkeys(out))


@dataclass
class Query:
    modifier: str | None
    select: list[Var]
    where: Group
    order: list[tuple[Var | None, bool]]  # variable (None: the count), ascending
    limit: int | None = None
    offset: int | None = None
    explain: bool = False


def integer(text: str) -> Term:
    return Term("L", text, None, XSD + "integer")


def conjuncts(e: object) -> list[object]:
    """The parts of a top-level && chain."""
    if isinstance(e, Call) and e.name == "&&":
        return [c for a in e.args for c in conjuncts(a)]
    return [e]


def variables_of(e: object) -> set[Var]:
    if isinstance(e, Var):
        return {e}
    if isinstance(e, Call):
        return {v for a in e.args for v in variables_of(a)}
    return set()
