"""Statistics of a store: cardinalities by predicate, join cardinalities of predicate pairs, summary cardinalities."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.plans.algebra import Pattern, Term, Var
from tripleloom.store import TripleStore


def predicate_stats(triples: DataFrame) -> DataFrame:
    """p, n, n_s, n_o: facts, distinct subjects and distinct objects of each predicate. Both counts come from histograms by
    value, so that a hot predicate's values are spread before anything is counted."""
    by_s = triples.groupBy("p", "s").agg(F.count(F.lit(1)).alias("c")).groupBy("p").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_s"))
    by_o = triples.groupBy("p", "o").agg(F.lit(1).alias("c")).groupBy("p").agg(F.count(F.lit(1)).alias("n_o"))
    return by_s.join(by_o, "p")


def join_stats(triples: DataFrame) -> DataFrame:
    """p1, p2, path, star1, star2: rows of the joins o=s, s=s and o=o of each pair of predicates that has any.

    Histograms (predicate, value, count) are joined on the value: a value meets itself once for each pair of predicates that
    have it, however many facts it is in."""
    by_s = triples.groupBy("p", F.col("s").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    by_o = triples.groupBy("p", F.col("o").alias("v")).agg(F.count(F.lit(1)).alias("c"))

    def pairs(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        l, r = left.toDF("p1", "v", "c1"), right.toDF("p2", "v", "c2")
        return l.join(r, "v").groupBy("p1", "p2").agg(F.sum(F.col("c1") * F.col("c2")).alias(name))

    parts = [pairs(by_o, by_s, "path"), pairs(by_s, by_s, "star1"), pairs(by_o, by_o, "star2")]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.groupBy("p1", "p2").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("path", "star1", "star2")))


def summary_stats(triples: DataFrame) -> DataFrame:
    """p, s_part, n."""
    return triples.groupBy("p", "s_part").agg(F.count(F.lit(1)).alias("n"))


def analyse(store: TripleStore) -> TripleStore:
    """Adds the statistics to a store; they are computed when first used, and written by ``save``."""
    store.predicate_stats = predicate_stats(store.triples)
    store.join_stats = join_stats(store.triples)
    return store


@dataclass
class Estimates:
    """Cardinalities of a query's patterns and of their joins. Without statistics, what is bound decides."""

    cards: dict[Pattern, float]
    pairs: dict[tuple[int, int], tuple[float, float, float]] = field(default_factory=dict)
    ids: dict[Term, int] = field(default_factory=dict)
    totals: dict[int, tuple[float, float, float]] = field(default_factory=dict)

    def card(self, p: Pattern) -> float:
        return self.cards[p]

    def selectivity(self, a: Pattern, b: Pattern) -> float:
        """Product over the shared variables of join rows / (rows of a x rows of b); 1 without any."""
        out = 1.0
        for v in set(a.variables) & set(b.variables):
            out *= self._one(a, b, v)
        return out

    def _one(self, a: Pattern, b: Pattern, v: Var) -> float:
        pa, pb = (self.ids.get(x.p) if isinstance(x.p, Term) else None for x in (a, b))
        if pa is not None and pb is not None and pa in self.totals and pb in self.totals:
            path, star1, star2 = self.pairs.get((pa, pb), (0.0, 0.0, 0.0))
            back = self.pairs.get((pb, pa), (0.0, 0.0, 0.0))[0]
            rows = {(True, True): star1, (False, False): star2, (False, True): path, (True, False): back}[a.s == v, b.s == v]
            return max(rows, 1.0) / max(1.0, self.totals[pa][0] * self.totals[pb][0])
        if v in (a.p, b.p):
            return 0.05  # predicates are few
        return 1.0 / max(10.0, min(self.card(a), self.card(b)))


#: Statistics of up to so many predicates and pairs of them are kept by the driver; of more, only those a query asks for are read.
MAX_PREDICATES = 10_000
MAX_PAIRS = 100_000


def _kept(store: TripleStore, name: str, make):
    if name not in store.known:
        store.known[name] = make()
    return store.known[name]


def _rows(store: TripleStore, name: str, df: DataFrame, limit: int, wanted: Column) -> list:
    """The rows of a statistics table, all of them if they are few, else those wanted."""
    few = _kept(store, name, lambda: df.limit(limit + 1).collect())
    return few if len(few) <= limit else df.where(wanted).collect()


def _ids(store: TripleStore, terms: list[Term]) -> dict[Term, int]:
    """Ids of constants; those that the dictionary hasn't got are left out."""
    store.look_up(set(terms))
    ids = store.known.setdefault("ids", {})
    new = [t for t in terms if t not in ids]
    if new:
        got = store.spark.range(1).select(*(store.id_of(t).alias(f"c{i}") for i, t in enumerate(new))).first()
        ids.update(zip(new, got))
    return {t: ids[t] for t in terms if ids[t] is not None}


def exact_counts(store: TripleStore, patterns: list[Pattern]) -> dict[Pattern, float]:
    """The numbers of facts of patterns with a bound subject or object, counted: values are far from evenly spread. One pass for
    each layout over the row groups that can hold any of them; kept, as a store doesn't change."""
    held = store.known.setdefault("counts", {})
    key = lambda p: tuple(t if isinstance(t, Term) else None for t in (p.s, p.p, p.o))
    bound = [p for p in patterns if isinstance(p.s, Term) or isinstance(p.o, Term)]
    for by_object in (False, True):
        mine = list({key(p): p for p in bound if key(p) not in held and (not isinstance(p.s, Term)) == by_object}.values())
        if not mine:
            continue
        tests = [reduce(lambda a, b: a & b, (F.col(c) == store.id_of(t) for c, t in zip("spo", key(p)) if t is not None)) for p in mine]
        got = store.scan(by_object).where(reduce(lambda a, b: a | b, tests)).agg(*(F.count_if(x) for x in tests)).first()
        held.update({key(p): float(n) for p, n in zip(mine, got)})
    return {p: held[key(p)] for p in bound}


def estimates(store: TripleStore, patterns: list[Pattern]) -> Estimates:
    """What the statistics hold of the query's predicates, and exact counts of patterns with a bound subject or object."""
    if store.predicate_stats is None or store.join_stats is None:
        weight = {(False, False, False): 1e9, (False, True, False): 1e6, (True, False, False): 1e3, (False, False, True): 1e4, (True, True, False): 1e1, (False, True, True): 1e3, (True, False, True): 1e1, (True, True, True): 1.0}
        return Estimates({p: weight[tuple(isinstance(t, Term) for t in (p.s, p.p, p.o))] for p in patterns})
    single = len(patterns) < 2
    if single and store.path is None:
        return Estimates({p: 1.0 for p in patterns})  # nothing to order, and the statistics aren't written yet
    ids = _ids(store, sorted({p.p for p in patterns if isinstance(p.p, Term)}, key=str))
    wanted = list(ids.values())
    totals = {r["p"]: (float(r["n"]), float(r["n_s"]), float(r["n_o"])) for r in _rows(store, "predicates", store.predicate_stats, MAX_PREDICATES, F.col("p").isin(wanted))}
    found = [] if single else _rows(store, "pairs", store.join_stats, MAX_PAIRS, F.col("p1").isin(wanted) & F.col("p2").isin(wanted))
    pairs = {(r["p1"], r["p2"]): (float(r["path"]), float(r["star1"]), float(r["star2"])) for r in found}
    everything = _kept(store, "facts", lambda: float(store.predicate_stats.agg(F.sum("n")).first()[0] or 1))
    # A single pattern needs no order, so nothing is counted for it; an even spread of its predicate's facts will do.
    counted = {} if single else exact_counts(store, patterns)
    cards = {}
    for p in patterns:
        n, n_s, n_o = totals.get(ids.get(p.p), (0.0, 1.0, 1.0)) if isinstance(p.p, Term) else (everything, 1.0, 1.0)
        cards[p] = counted[p] if p in counted else n / (n_s if isinstance(p.s, Term) else 1) / (n_o if isinstance(p.o, Term) else 1)
    return Estimates(cards, pairs, ids, totals)
