"""SPARQL over a store: queries become DataFrame plans, which Catalyst and adaptive execution carry out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.expressions import Expressions, UserFunction
from tripleloom.functions.terms import TERM_FIELDS, Value, term_id
from tripleloom.plans import planner
from tripleloom.plans.algebra import Group, Pattern, Query, TableCall, Term, Var, variables_of
from tripleloom.plans.parser import SparqlError, parse
from tripleloom.plans.stats import Estimates, estimates
from tripleloom.plans.summary import candidates, kept_share, prune_all
from tripleloom.runtime import ready, stored
from tripleloom.store import TripleStore


@dataclass(frozen=True)
class TableFunction:
    """A table function: gets the columns of its inputs (of the kinds in ``takes``) and gives an array, of structs if it has
    several outputs; each element is a row. gives: the kind of each output (number, text)."""

    call: Callable[..., Column]
    takes: tuple[str, ...]
    gives: tuple[str, ...]


@dataclass
class Rows:
    """Solutions: a column of ids for each variable; variables that may be unbound; those that carry their term along."""

    df: DataFrame
    variables: list[Var]
    loose: set[Var] = field(default_factory=set)
    terms: set[Var] = field(default_factory=set)


class Engine:
    """Answers queries over one store. summary: prune by the summary graph first. prune_unused: under DISTINCT, scans keep
    only the distinct values of the variables that are used elsewhere."""

    def __init__(self, store: TripleStore, summary: bool = False, prune_unused: bool = True):
        ready(store.spark)
        self.store, self.summary, self.prune_unused = store, summary, prune_unused
        self.functions: dict[str, UserFunction] = {}
        self.tables: dict[str, TableFunction] = {}

    def register_function(self, iri: str, call: Callable[..., Column], takes: tuple[str, ...], gives: str) -> None:
        self.functions[iri] = UserFunction(call, takes, gives)

    def register_table_function(self, name: str, call: Callable[..., Column], takes: tuple[str, ...], gives: tuple[str, ...]) -> None:
        self.tables[name] = TableFunction(call, takes, gives)

    # entry points

    def query(self, text: str, result: str = "lex") -> DataFrame:
        """Solutions with a column for each selected variable, in the order of selection.

        result: lex (texts), terms (structs kind, lex, lang, dt) or ids (no dictionary access unless a filter or an order
        needs it). COUNT and DUPLICATES add the column count. Names that differ only in case get a number, as Spark's
        don't. A query that begins with EXPLAIN gives the lines of its plan. SparqlError for texts that are no query."""
        if result not in ("lex", "terms", "ids"):
            raise ValueError(f"unknown result {result}")
        query = parse(text)
        if query.explain:
            return self.store.spark.createDataFrame([(line,) for line in self.explain(text).split("\n")], "plan string")
        return _Run(self, query).result(result)

    def explain(self, text: str) -> str:
        """The join order of each group of patterns with estimated rows, and Spark's plan."""
        run = _Run(self, parse(text))
        df = run.result("lex")
        spark_plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return "\n".join(planner.describe(t) for t in run.trees) + "\n\n" + spark_plan


class _Run:
    def __init__(self, engine: Engine, query: Query):
        self.engine, self.store, self.q = engine, engine.store, query
        self.trees: list[planner.Tree] = []
        self.number: dict[Var, int] = {}
        ordered = {v for v, _ in query.order if v is not None}
        known = set(query.where.variables())
        self.order = [(v, up) for v, up in query.order if (v is None and query.modifier in ("count", "duplicates")) or v in known]
        self.needed = set(query.select) | ordered
        self.distinct = query.modifier == "distinct"
        constants: set[Term] = set()
        _constants(query.where, constants)
        self.store.look_up(constants)
        self.uses: dict[Var, int] = {}
        _uses(query.where, self.uses)

    def v(self, var: Var) -> str:
        return f"v{self.number.setdefault(var, len(self.number))}"

    def t(self, var: Var) -> str:
        return f"t{self.v(var)[1:]}"

    # results

    def result(self, form: str) -> DataFrame:
        q = self.q
        rows = self.group(q.where)
        for var in dict.fromkeys([*q.select, *(v for v, _ in self.order if v)]):
            if var not in rows.variables:
                rows = Rows(rows.df.withColumn(self.v(var), F.lit(None).cast("long")), [*rows.variables, var], rows.loose | {var}, rows.terms)
        counted = q.modifier in ("count", "duplicates")
        names = _unique([v.name for v in q.select] + ["count"] * counted)
        keys = [self.v(v) for v in q.select] + [self.t(v) for v in q.select if v in rows.terms]
        sorts = [v for v, _ in self.order if v is not None]
        df = rows.df
        if counted:
            df = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
            if q.modifier == "duplicates":
                df = df.where(F.col("count") > 1)
            sorts = [v for v in sorts if v in q.select]
        elif self.distinct:
            df = df.select(*dict.fromkeys(keys)).distinct()
            sorts = [v for v in sorts if v in q.select]
        rows = Rows(df, [v for v in rows.variables if self.v(v) in df.columns], rows.loose, rows.terms)
        late = q.limit is not None and not set(sorts) >= set(q.select)
        rows = self.with_terms(rows, sorts if late or form == "ids" else [*sorts, *q.select])
        by: list[Column] = []
        if self.order:
            for var, up in self.order:
                if var is None:
                    by.append(F.col("count").asc() if up else F.col("count").desc())
                elif var in sorts:
                    by += [c.asc_nulls_first() if up else c.desc_nulls_last() for c in self.value(var).sort_key()]
            rows.df = rows.df.orderBy(*by) if by else rows.df
        if q.offset:
            rows.df = rows.df.offset(q.offset)
        if q.limit is not None:
            rows.df = rows.df.limit(q.limit)
        if late and form != "ids":
            # The dictionary is joined to the limited rows only; their order is made again, as a join doesn't keep it.
            rows = self.with_terms(rows, q.select)
            rows.df = rows.df.orderBy(*by) if by else rows.df
        pick = {"ids": lambda v: F.col(self.v(v)), "terms": lambda v: F.col(self.t(v)), "lex": lambda v: F.col(f"{self.t(v)}.lex")}[form]
        out = [pick(v).alias(n) for v, n in zip(q.select, names)]
        return rows.df.select(*out, *([F.col("count").alias(names[-1])] if counted else []))

    def with_terms(self, rows: Rows, variables) -> Rows:
        """Joins the dictionary for the variables that don't carry their terms yet."""
        df, have = rows.df, set(rows.terms)
        for var in dict.fromkeys(variables):
            if var in have or var not in rows.variables:
                continue
            named = self.store.terms.select(F.col("id").alias(self.v(var)), F.struct(*TERM_FIELDS).alias(self.t(var)))
            df = df.join(named, self.v(var), "left" if var in rows.loose or not self.store.hashed else "inner")
            have.add(var)
        return Rows(df, rows.variables, rows.loose, have)

    def value(self, var: Var) -> Value:
        return Value.of_term(*(F.col(f"{self.t(var)}.{f}") for f in TERM_FIELDS))

    def expressions(self, variables) -> Expressions:
        return Expressions({v: self.value(v) for v in variables}, self.engine.functions)

    # groups

    def group(self, g: Group) -> Rows:
        filters = list(g.filters)
        rows = self.patterns(g.patterns, filters) if g.patterns else None
        for branches in g.unions:
            mine = self.union([self.group(b) for b in branches])
            rows = mine if rows is None else self.join(rows, mine, "inner")
        if rows is None:
            rows = Rows(self.store.spark.range(1).select(), [])
        for t in g.tables:
            rows = self.table(rows, t)
        for o in g.optionals:
            rows = self.optional(rows, o)
        for f in filters:
            rows = self.filtered(rows, f)
        return rows

    def filtered(self, rows: Rows, e: object) -> Rows:
        used = [v for v in variables_of(e) if v in rows.variables]
        rows = self.with_terms(rows, used)
        return Rows(rows.df.where(self.expressions(used).condition(e)), rows.variables, rows.loose, rows.terms)

    def patterns(self, patterns: list[Pattern], filters: list[object]) -> Rows:
        """A basic graph pattern; takes those filters off the list that can go below its joins."""
        patterns = list(dict.fromkeys(patterns))
        est = estimates(self.store, patterns)
        allowed = candidates(self.store, patterns) if self.engine.summary else {}
        est.cards = {p: n * kept_share(p, allowed) for p, n in est.cards.items()}
        parts = []
        for component in planner.components(patterns):
            tree = planner.plan(component, est)
            self.trees.append(tree)
            parts.append(self.tree(tree, filters, allowed, est))
        return reduce(lambda a, b: self.join(a, b, "inner"), parts)

    def tree(self, tree: planner.Tree, filters: list[object], allowed: Mapping, est: Estimates) -> Rows:
        if isinstance(tree, planner.Leaf):
            rows = self.scan(tree.pattern, allowed)
        else:
            rows = self.join(self.tree(tree.left, filters, allowed, est), self.tree(tree.right, filters, allowed, est), "inner")
        for f in list(filters):
            used = variables_of(f)
            if used and used <= set(rows.variables):
                rows = self.filtered(rows, f)
                filters.remove(f)
        return rows

    def scan(self, p: Pattern, allowed: Mapping) -> Rows:
        """Selections and pruning go into the scan; a repeated variable is an equality."""
        df = self.store.scan(object_bound=isinstance(p.o, Term) and not isinstance(p.s, Term))
        df = prune_all(df, p, allowed)
        columns: dict[Var, str] = {}
        for name, term in (("s", p.s), ("p", p.p), ("o", p.o)):
            if isinstance(term, Term):
                df = df.where(F.col(name) == self.store.id_of(term))
            elif term in columns:
                df = df.where(F.col(name) == F.col(columns[term]))
            else:
                columns[term] = name
        used = dict(columns)
        if self.distinct and self.engine.prune_unused:
            kept = {v: c for v, c in columns.items() if v in self.needed or self.uses.get(v, 0) > 1}
            if kept and len(kept) < len(columns):
                used = kept
        out = df.select(*(F.col(c).alias(self.v(v)) for v, c in used.items()))
        return Rows(out.distinct() if len(used) < len(columns) else out, list(used))

    def join(self, a: Rows, b: Rows, how: str) -> Rows:
        """On all shared variables. Where one of them may be unbound, unbound is compatible with anything."""
        shared = [v for v in a.variables if v in b.variables]
        soft = [v for v in shared if v in a.loose or v in b.loose]
        if soft:
            return self.soft_join(a, b, how, shared, soft)
        variables = a.variables + [v for v in b.variables if v not in shared]
        right = b.df.drop(*(self.t(v) for v in shared if v in a.terms and v in b.terms))
        if not shared:
            df = a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        else:
            df = a.df.join(right, [self.v(v) for v in shared], how)
        loose = a.loose | ({v for v in b.variables if v not in a.variables} if how == "left" else b.loose)
        return Rows(df, variables, loose, a.terms | b.terms)

    def soft_join(self, a: Rows, b: Rows, how: str, shared: list[Var], soft: list[Var]) -> Rows:
        """A join on variables that may be unbound: for each choice of the variables that are unbound on either side, an equi-join
        on those that are bound on both; a row of each side is in one choice, so that the joins add up."""
        mine, theirs = ([v for v in soft if v in side.loose] for side in (a, b))
        if how == "left" and theirs:
            return self.left_by_rows(a, b, [])
        both_terms = {v for v in shared if v not in soft and v in a.terms}
        left = a.df.drop(*(self.t(v) for v in soft if v in a.terms))
        right = b.df.drop(*(self.t(v) for v in shared if v in b.terms and (v in soft or v in both_terms)))
        names = {self.v(v): f"r_{self.v(v)}" for v in shared}
        right = right.withColumnsRenamed(names)
        others = [c for c in [*left.columns, *right.columns] if c not in names and c not in names.values()]
        parts = []
        for unbound in _subsets(mine):
            here = _chosen(left, [self.v(v) for v in mine], [self.v(v) for v in unbound])
            for missing in _subsets(theirs):
                there = _chosen(right, [names[self.v(v)] for v in theirs], [names[self.v(v)] for v in missing])
                keys = [self.v(v) for v in shared if v not in unbound and v not in missing]
                on = reduce(lambda x, y: x & y, (F.col(k) == F.col(names[k]) for k in keys)) if keys else None
                if on is not None:
                    df = here.join(there, on, how)
                else:
                    df = here.crossJoin(there) if how == "inner" else here.join(there, F.lit(True), how)
                parts.append(df.select(*(F.coalesce(c, r).alias(c) for c, r in names.items()), *others))
        variables = a.variables + [v for v in b.variables if v not in shared]
        new = {v for v in b.variables if v not in a.variables}
        loose = a.loose | new if how == "left" else (a.loose - set(shared)) | (b.loose - set(shared)) | (a.loose & b.loose & set(shared))
        return Rows(reduce(DataFrame.unionByName, parts), variables, loose, {v for v in a.terms | b.terms if v not in soft})

    def optional(self, rows: Rows, g: Group) -> Rows:
        """A left join; filters of the optional group belong to its condition and see the variables of both sides."""
        inner = Group(g.patterns, [], g.tables, g.unions, g.optionals)
        outer_only = [f for f in g.filters if not variables_of(f) <= set(inner.variables())]
        inner.filters = [f for f in g.filters if f not in outer_only]
        right = self.group(inner)
        return self.left_by_rows(rows, right, outer_only) if outer_only else self.join(rows, right, "left")

    def left_by_rows(self, rows: Rows, right: Rows, conditions: list[object]) -> Rows:
        """A left join by numbered rows: what joins and meets the conditions, and the rows of which nothing does."""
        row = "row_" + str(len(self.number))
        # The row numbers must be the same on both sides.
        tagged = Rows(stored(rows.df.withColumn(row, F.monotonically_increasing_id()), "left"), rows.variables, rows.loose, rows.terms)
        both = self.join(tagged, right, "inner")
        for f in conditions:
            both = self.filtered(both, f)
        # Variables that were unbound may have got a value, so all come from the joined side.
        kept = [*dict.fromkeys([*rows.variables, *both.variables])]
        carried = [v for v in kept if v in both.terms]
        lone = self.with_terms(tagged, [v for v in carried if v in rows.variables])
        lone_df = lone.df.join(both.df.select(row), row, "left_anti")
        columns = [*(self.v(v) for v in kept), *(self.t(v) for v in carried)]
        df = both.df.select(*columns).unionByName(lone_df.select(*(c for c in columns if c in lone_df.columns)), allowMissingColumns=True)
        return Rows(df, kept, rows.loose | {v for v in kept if v not in rows.variables}, set(carried))

    def union(self, branches: list[Rows]) -> Rows:
        every = list(dict.fromkeys(v for b in branches for v in b.variables))
        carried = {v for v in every if all(v in b.terms for b in branches if v in b.variables)}
        made = {v for b in branches for v in b.terms} - carried
        branches = [self.with_terms(b, made) for b in branches]
        carried |= made
        dfs = [b.df.select(*(self.v(v) for v in b.variables), *(self.t(v) for v in b.variables if v in carried)) for b in branches]
        loose = {v for v in every if any(v not in b.variables or v in b.loose for b in branches)}
        return Rows(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs), every, loose, carried)

    def table(self, rows: Rows, t: TableCall) -> Rows:
        f = self.engine.tables.get(t.name)
        if f is None or len(t.inputs) != len(f.takes) or len(t.outputs) != len(f.gives):
            raise SparqlError(f"no table function {t.name} with {len(t.inputs)} inputs and {len(t.outputs)} outputs")
        used = [v for i in t.inputs for v in variables_of(i) if v in rows.variables]
        rows = self.with_terms(rows, used)
        scope = self.expressions(used)
        made = f.call(*(scope._as(scope.value(i), k) for i, k in zip(t.inputs, f.takes)))
        kept = rows.df.columns
        df = rows.df.select(*kept, F.explode(made).alias("_made"))
        first = next(x for x in df.schema if x.name == "_made").dataType
        cells = [F.col(f"_made.`{n}`") for n in first.names] if hasattr(first, "names") else [F.col("_made")]
        variables, terms, known = list(rows.variables), set(rows.terms), []
        for var, cell, kind in zip(t.outputs, cells, f.gives):
            whole = cell.try_cast("bigint") == cell if kind == "number" else None
            value = Value.of_number(cell.cast("double"), cell.try_cast("decimal(38,18)")) if kind == "number" else Value.of_text(cell.cast("string"))
            dt = F.when(whole, F.lit("http://www.w3.org/2001/XMLSchema#integer")).otherwise(value.dt) if kind == "number" else value.dt
            parts = (F.lit("L"), value.lex, F.lit(None).cast("string"), dt)
            term = F.struct(*(x.alias(n) for x, n in zip(parts, TERM_FIELDS)))
            if var in rows.variables:
                known.append((var, term))
                continue
            df = df.withColumn(self.v(var), term_id(*parts)).withColumn(self.t(var), term)
            variables.append(var)
            terms.add(var)
        out = Rows(df, variables, rows.loose, terms)
        for var, term in known:
            out = self.with_terms(out, [var])
            got = Value.of_term(*(term[n] for n in TERM_FIELDS))
            out.df = out.df.where(self.value(var).equals(got))
        out.df = out.df.drop("_made")
        return out


def _constants(g: Group, out: set[Term]) -> None:
    out.update(t for p in g.patterns for t in (p.s, p.p, p.o) if isinstance(t, Term))
    for inner in [*g.optionals, *(b for u in g.unions for b in u)]:
        _constants(inner, out)


def _uses(g: Group, out: dict[Var, int]) -> None:
    """How many patterns, filters and table functions mention each variable."""
    for p in g.patterns:
        for v in p.variables:
            out[v] = out.get(v, 0) + 1
    for f in g.filters:
        for v in variables_of(f):
            out[v] = out.get(v, 0) + 1
    for t in g.tables:
        for v in {*t.outputs, *(x for i in t.inputs for x in variables_of(i))}:
            out[v] = out.get(v, 0) + 1
    for inner in [*g.optionals, *(b for u in g.unions for b in u)]:
        _uses(inner, out)


def _subsets(items: list) -> list[list]:
    return [[x for i, x in enumerate(items) if n >> i & 1] for n in range(1 << len(items))]


def _chosen(df: DataFrame, columns: list[str], unbound: list[str]) -> DataFrame:
    """The rows in which, of the columns, just ``unbound`` are null."""
    for c in columns:
        df = df.where(F.col(c).isNull() if c in unbound else F.col(c).isNotNull())
    return df


def _unique(names: list[str]) -> list[str]:
    """Column names that also differ without case."""
    taken: set[str] = set()
    out = []
    for n in names:
        name, i = n, 2
        while name.lower() in taken:
            name, i = f"{n}_{i}", i + 1
        taken.add(name.lower())
        out.append(name)
    return out
