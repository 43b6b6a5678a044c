"""The summary graph: which graph partitions are linked by which predicate. A query is first answered over it, and the
partitions that a variable can still be in prune the scans of the real query before they are joined."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.plans.algebra import Pattern, Var
from tripleloom.runtime import stored
from tripleloom.store import TripleStore

#: Partition sets up to this size become a list in the scan's filter; larger ones are joined with.
MAX_LISTED = 1_000
UNASSIGNED = -1


def summary_edges(store: TripleStore) -> DataFrame:
    """p, s_part, o_part, distinct; unassigned terms are in partition -1."""
    part = lambda c: F.coalesce(c, F.lit(UNASSIGNED)).alias(c)
    return store.triples.select("p", part("s_part"), part("o_part")).distinct()


def hash_parts(store: TripleStore, n: int) -> DataFrame:
    """(id, part) for every subject by hash."""
    return store.triples.select(F.col("s").alias("id")).distinct().select("id", (F.pmod(F.xxhash64("id"), F.lit(n)) + 100).cast("int").alias("part"))


def file_parts(store: TripleStore, parts_path: str, terms_path: str) -> DataFrame:
    """(id, part) from two line-aligned text files: a partition number in a line of one, its term's text in the same line of
    the other. Lines without a number, and terms that the dictionary hasn't got, are left out; a text that several terms
    have gives its partition to each that isn't a literal."""
    spark = store.spark

    def numbered(path: str, name: str) -> DataFrame:
        """Lines by number: their place in the split they are read from, after the lines of the splits before."""
        split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
        lines = spark.read.text(path).select(*split, F.col("value").alias(name), F.monotonically_increasing_id().alias("place"))
        sizes = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
        before = sizes.select("file", "start", (F.sum("n").over(Window.orderBy("file", "start")) - F.col("n")).alias("before"))
        place = F.row_number().over(Window.partitionBy("file", "start").orderBy("place"))
        return lines.join(F.broadcast(before), ["file", "start"]).select((F.col("before") + place).alias("line"), name)

    both = numbered(parts_path, "part").join(numbered(terms_path, "lex"), "line")
    number = F.trim("part").try_cast("int")
    return store.terms.where("kind <> 'L'").join(both.select("lex", number.alias("part")).where("part IS NOT NULL"), "lex").select("id", "part")


def label_parts(store: TripleStore, rounds: int = 5, max_share: float = 0.05) -> DataFrame:
    """(id, part) by label propagation over links between subjects: each takes the most frequent label among its neighbours,
    ties to the smallest. A label that holds more than ``max_share`` of the subjects isn't taken over any more, so one hub
    doesn't swallow the graph. Parts are numbered from 100."""
    nodes = store.triples.select(F.col("s").alias("id")).distinct()
    links = store.triples.where("s <> o").select("s", "o").join(nodes.select(F.col("id").alias("o")), "o", "left_semi")
    links = stored(links.union(links.select("o", "s")).distinct().toDF("a", "b"), "links")
    labels = stored(nodes.select("id", F.col("id").alias("label")), "labels")
    n = labels.count()
    for _ in range(rounds):
        big = labels.groupBy("label").count().where(F.col("count") > max(2, max_share * n)).select("label")
        votes = links.join(labels.select(F.col("id").alias("b"), "label"), "b").join(F.broadcast(big), "label", "left_anti").groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select(F.col("a").alias("id"), F.col("m.label").alias("new"))
        labels = stored(labels.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")
    from tripleloom.operators.wide import ordinals

    numbers = ordinals(labels, "label").select("label", (F.col("ordinal") + 100).cast("int").alias("part"))
    return labels.join(numbers, "label").select("id", "part")


@dataclass(frozen=True)
class Allowed:
    """Partitions that a variable can be in: a list if they are few, else a table; and their share of all partitions."""

    listed: list[int] | None
    table: DataFrame
    share: float


def candidates(store: TripleStore, patterns: list[Pattern]) -> dict[Var, Allowed]:
    """For variables that are a subject somewhere: the partitions that they can be in.

    A literal lies in its subject's partition, so a variable that is only an object has no partition of its own: its
    occurrences aren't joined and it isn't pruned. Constants only restrict by their predicate."""
    edges = store.summary if store.summary is not None else summary_edges(store)
    subjects = {p.s for p in patterns if isinstance(p.s, Var)}
    if not subjects:
        return {}
    edges = stored(edges, "summary")
    names: dict[Var, str] = {v: f"q{i}" for i, v in enumerate(sorted(subjects, key=lambda v: v.name))}
    rows: DataFrame | None = None
    left = list(patterns)
    bound: set[Var] = set()
    while left:
        p = next((x for x in left if bound & set(x.variables)), left[0])
        left.remove(p)
        mine = [v for v in dict.fromkeys((p.s, p.o)) if isinstance(v, Var) and v in names]
        if not mine:
            continue
        e = edges if isinstance(p.p, Var) else edges.where(F.col("p") == store.id_of(p.p))
        if p.s == p.o:
            e = e.where("s_part = o_part")
        e = e.select(*(F.col("s_part" if v == p.s else "o_part").alias(names[v]) for v in mine)).distinct()
        shared = [names[v] for v in mine if v in bound]
        if rows is None:
            rows = e
        elif shared:
            rows = rows.join(e, shared)
        else:
            continue  # another component: it is left unpruned rather than multiplied
        bound.update(mine)
    if rows is None:
        return {}
    rows = stored(rows.distinct(), "candidates")
    total = max(1, edges.select("s_part").distinct().count())
    return {v: _allowed(rows.select(F.col(names[v]).alias("part")).distinct(), total) for v in bound}


def _allowed(parts: DataFrame, total: int) -> Allowed:
    some = [r["part"] for r in parts.limit(MAX_LISTED + 1).collect()]
    listed = sorted(some) if len(some) <= MAX_LISTED else None
    n = len(some) if listed is not None else parts.count()
    return Allowed(listed, parts, min(1.0, n / total))


def pruned(scan: DataFrame, column: str, allowed: Allowed) -> DataFrame:
    """The facts whose partition is among the candidates."""
    if allowed.listed is not None:
        real = [x for x in allowed.listed if x != UNASSIGNED]
        keep: Column = F.col(column).isin(real) if real else F.lit(False)
        return scan.where(keep | F.col(column).isNull() if UNASSIGNED in allowed.listed else keep)
    own = F.coalesce(F.col(column), F.lit(UNASSIGNED))
    return scan.join(allowed.table.withColumnRenamed("part", "_part"), own == F.col("_part"), "left_semi")


def prune_all(scan: DataFrame, p: Pattern, allowed: Mapping[Var, Allowed]) -> DataFrame:
    for term, column in ((p.s, "s_part"), (p.o, "o_part")):
        if isinstance(term, Var) and term in allowed:
            scan = pruned(scan, column, allowed[term])
    return scan


def kept_share(p: Pattern, allowed: Mapping[Var, Allowed]) -> float:
    """Share of a pattern's facts that pruning is estimated to keep."""
    out = 1.0
    for term in dict.fromkeys((p.s, p.o)):
        if isinstance(term, Var) and term in allowed:
            out *= allowed[term].share
    return out


__all__ = ["summary_edges", "hash_parts", "file_parts", "label_parts", "candidates", "prune_all", "kept_share"]
