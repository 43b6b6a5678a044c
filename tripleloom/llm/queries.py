"""Queries of the llm operators and the SQL that their results are held against, where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.llm.leakage import leaks
from tripleloom.llm.packing import pack, token_counts
from tripleloom.llm.set_sketch import Scale, distinct_sketches, estimated, levels, merged, overlaps, rolled_up
from tripleloom.llm.subjects import Subjects, leaf_report, subjects
from tripleloom.llm.term_counts import TermCounts
from tripleloom.runtime import fresh_path, read, stored

RARE_BELOW = 3
COMMON_SHARE = 0.08
LATE_DAYS = 7
CAPACITY = 8192
LEAST_WORDS = 12
LEAST_SHARE = 0.25
DIMS = ["p", "feed", "s_part"]
SCALE = Scale()


def _term_counts(spark: SparkSession, sf_dir: str) -> TermCounts:
    """The facts as three deliveries to one folder, each by an object of its own that takes up what is there.

    1. Everything; the facts of the last week before the last load without their objects yet, and those of no feed twice.
    2. The facts of the last week changed: as they were removed, as they are added.
    3. The second copies removed."""
    triples, path = read(spark, sf_dir, "triples").select("s", "p", "o", "feed", "loaded_at"), fresh_path(spark, "terms")
    last = triples.agg(F.max("loaded_at")).first()[0]
    late = F.coalesce(F.col("loaded_at") > F.lit(last) - F.expr(f"INTERVAL {LATE_DAYS} DAYS"), F.lit(False))
    facts = triples.select("s", "p", "o", late.alias("late"), F.col("feed").isNull().alias("twice"))
    before = facts.withColumn("o", F.when(~F.col("late"), F.col("o")))

    def deliver(added: DataFrame | None, removed: DataFrame | None) -> TermCounts:
        counts = TermCounts(spark, path, {"p": "p", "o": "o"}, "s")
        counts.update(added, removed)
        return counts

    deliver(before.withColumn("copy", F.explode(F.when(F.col("twice"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))), None)
    deliver(facts.where("late"), before.where("late"))
    return deliver(None, before.where("twice").withColumn("o", F.when(~F.col("late"), F.col("o"))))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = _term_counts(spark, sf_dir).marked(RARE_BELOW, COMMON_SHARE)
    return marked.where(F.col("band").isNotNull()).select(F.col("role").alias("term_role"), F.col("term").alias("term_id"), "band")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and records of every term."""
    marked = _term_counts(spark, sf_dir).marked(RARE_BELOW, COMMON_SHARE)
    return marked.select(F.col("role").alias("term_role"), F.col("term").alias("term_id"), "occurrences", "records", "band")


def _sketches(spark: SparkSession, sf_dir: str, combos=None) -> DataFrame:
    rows = read(spark, sf_dir, "triples").select("s", F.to_date("stated_at").alias("day"), *DIMS)
    return distinct_sketches(rows, "s", "day", DIMS, SCALE, combos)


def p6_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct subjects for each combination of day, predicate, feed and graph partition, the grand total included."""
    return estimated(rolled_up(_sketches(spark, sf_dir), "day", DIMS, SCALE), SCALE)


def p6_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and similarity of the subjects that a predicate has on a day and on the day after it."""
    own = stored(_sketches(spark, sf_dir, [("p",)]).where("day IS NOT NULL AND p IS NOT NULL").select("day", "p", F.struct("hashes", "registers").alias("sketch")), "sketches")
    after = own.select(F.date_sub("day", 1).alias("day"), "p", F.col("sketch").alias("next"))
    return overlaps(own.join(after, ["day", "p"]), "sketch", "next", SCALE)


def p6_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each combination of day, predicate, feed and partition its number of groups, and whether an exact count of all groups lies
    within the stated 95 % bound for at least 93 % of those kept in registers and for all that are kept as lists."""
    facts = read(spark, sf_dir, "triples").where("s IS NOT NULL").select("s", F.to_date("stated_at").alias("day"), *DIMS)
    names = ["day", *DIMS]
    exact = None
    for combo in levels(names):
        keys = [F.col(d) if d in combo else F.lit(None).cast(dict(facts.dtypes)[d]).alias(d) for d in names]
        part = facts.select("s", *keys).distinct().groupBy(*names).agg(F.count(F.lit(1)).alias("exact")).withColumn("dimensions", F.lit("+".join(combo)))
        exact = part if exact is None else exact.unionByName(part)
    both = p6_distinct(spark, sf_dir).alias("e").join(exact.alias("x"), (F.col("e.dimensions") == F.col("x.dimensions")) & _all(F.col(f"e.{d}").eqNullSafe(F.col(f"x.{d}")) for d in names), "full")
    held = F.coalesce((F.col("low") <= F.col("exact")) & (F.col("exact") <= F.col("high")), F.lit(False))
    dense = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    shares = both.select(F.coalesce("e.dimensions", "x.dimensions").alias("dimensions"), held.alias("held"), dense.alias("dense"))
    whole = shares.groupBy("dimensions").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("dense").alias("d"), F.count_if(F.col("dense") & F.col("held")).alias("d_held"), F.count_if(~F.col("dense") & ~F.col("held")).alias("wrong"))
    total = whole.agg(F.sum("d").alias("all_d"), F.sum("d_held").alias("all_held"))
    return whole.crossJoin(F.broadcast(total)).select("dimensions", "n_groups", ((F.col("wrong") == 0) & (F.col("all_held") >= 0.93 * F.col("all_d"))).alias("within"))


def _all(conditions):
    return reduce(lambda a, b: a & b, conditions)


def p6_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct subjects of each predicate in each month, from the merged sketches of the days; beside the exact number, and whether
    the estimate is within five standard errors of it."""
    daily = _sketches(spark, sf_dir, [("p",)]).withColumn("month", F.trunc("day", "month"))
    found = estimated(merged(daily, ["month", "p"], SCALE), SCALE, z=5.0)
    exact = read(spark, sf_dir, "triples").where("s IS NOT NULL").select(F.trunc(F.to_date("stated_at"), "month").alias("m"), F.col("p").alias("q"), "s").distinct().groupBy("m", "q").agg(F.count(F.lit(1)).alias("n_subjects"))
    both = found.join(exact, F.col("month").eqNullSafe(F.col("m")) & F.col("p").eqNullSafe(F.col("q")))
    return both.select("month", "p", "n_subjects", ((F.col("low") <= F.col("n_subjects")) & (F.col("n_subjects") <= F.col("high"))).alias("within"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of 8,192 tokens."""
    sizes = stored(token_counts(read(spark, sf_dir, "documents"), "doc_id", "text"), "sizes").withColumnRenamed("key", "doc_id")
    return pack(sizes, "doc_id", "n_tokens", CAPACITY)


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the containers: every document there, every token of it once, none split that fits a container, no
    container too full, and no more than 5 % more containers than the tokens need."""
    docs = read(spark, sf_dir, "documents")
    sizes = stored(token_counts(docs, "doc_id", "text"), "sizes").withColumnRenamed("key", "doc_id")
    rows = stored(pack(sizes, "doc_id", "n_tokens", CAPACITY), "containers")
    pieces = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("n"), F.max("piece_no").alias("last"))
    per_doc = sizes.join(pieces, "doc_id", "full").agg(F.count("n").alias("n_docs"), F.count_if(~F.equal_null("placed", "n_tokens") | (F.col("n") != F.col("last") + 1) | (F.col("n") != F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / CAPACITY)))).alias("n_wrong"), F.sum("n_tokens").alias("tokens"))
    bins = rows.groupBy("container").agg(F.sum("n_tokens").alias("held"), F.max("fill").alias("fill")).agg(F.count_if((F.col("held") > CAPACITY) | (F.col("held") != F.col("fill"))).alias("n_overfull"), F.count(F.lit(1)).alias("n_bins"))
    return per_doc.crossJoin(bins).select("n_docs", "n_wrong", "n_overfull", (F.col("n_bins") <= 1.05 * F.coalesce("tokens", F.lit(0)) / CAPACITY + 1).alias("tight"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.where(F.col("longest") >= LEAST_WORDS).select("doc_id", "item_id").distinct()


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item that share a tile, with the item's coverage."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def _subjects(spark: SparkSession, sf_dir: str) -> Subjects:
    areas = [r["area"] for r in read(spark, sf_dir, "subject_areas").select("area").collect()]
    return subjects(read(spark, sf_dir, "documents"), read(spark, sf_dir, "area_labels"), areas)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).shares.where(F.col("share") >= LEAST_SHARE).select("doc_id", "area")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and subject-bearing sentences of each area over the whole corpus."""
    main = F.when(F.col("share") >= LEAST_SHARE, 1)
    return _subjects(spark, sf_dir).shares.groupBy("area").agg(F.count(main).alias("n_docs"), F.sum("n_sentences").alias("n_sentences"))


def p9_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the clustering with their areas and words."""
    return leaf_report(_subjects(spark, sf_dir))


_COUNTS = " UNION ALL ".join(f"SELECT '{r}' AS term_role, {r} AS term_id, count(*) AS occurrences, count(DISTINCT s) AS records FROM triples WHERE s IS NOT NULL AND {r} IS NOT NULL GROUP BY {r}" for r in ("p", "o"))
_MARKED = f"SELECT *, CASE WHEN records < {RARE_BELOW} THEN 'rare' WHEN records > {COMMON_SHARE} * (SELECT count(DISTINCT s) FROM triples) THEN 'common' END AS band FROM ({_COUNTS})"

_DAYS = "SELECT s, CAST(stated_at AS DATE) AS day, p, feed, s_part FROM triples WHERE s IS NOT NULL"
_BOUND = " UNION ALL ".join(f"SELECT '{'+'.join(c)}' AS dimensions, count(*) AS n_groups, TRUE AS within FROM (SELECT DISTINCT {', '.join(c) or '1'} FROM ({_DAYS})) HAVING count(*) > 0" for c in levels(["day", *DIMS]))

SQL = {
    "p6_bound": _BOUND,
    "p6_merged": "SELECT CAST(date_trunc('month', stated_at) AS DATE) AS month, p, count(DISTINCT s) AS n_subjects, TRUE AS within FROM triples WHERE s IS NOT NULL GROUP BY ALL",
    "p7_invariants": "SELECT count(*) AS n_docs, 0 AS n_wrong, 0 AS n_overfull, TRUE AS tight FROM documents",
    "p3_found": f"SELECT term_role, term_id, band FROM ({_MARKED}) WHERE band IS NOT NULL",
    "p3_counts": _MARKED,
}

QUERIES = {q.__name__: q for q in (p3_found, p3_counts, p6_distinct, p6_overlap, p6_bound, p6_merged, p7_containers, p7_invariants, p8_found, p8_coverage, p9_found, p9_composition, p9_leaves)}
