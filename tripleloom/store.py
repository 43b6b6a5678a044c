"""The triple store: encoded facts, the dictionary, statistics and the summary graph as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.terms import TERM_FIELDS, term_id
from tripleloom.functions.xsd import XSD
from tripleloom.plans.algebra import Term
from tripleloom.runtime import exists, stored


@dataclass
class TripleStore:
    """triples: s, p, o (ids), s_part, o_part (graph partitions, null where unassigned); a set.
    terms: id, kind, lex, lang, dt. hashed: ids are hashes of the terms, so a constant's id needs no lookup."""

    triples: DataFrame
    terms: DataFrame
    identity: str = "rdf"
    hashed: bool = True
    by_object: DataFrame | None = None
    predicate_stats: DataFrame | None = None
    join_stats: DataFrame | None = None
    summary: DataFrame | None = None
    path: str | None = None
    skipped: DataFrame | None = None
    #: Facts and dictionary don't change, so numbers that were looked up once are kept: statistics, counts of patterns.
    known: dict = field(default_factory=dict)
    _ids: dict[Term, int | None] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.triples.sparkSession

    # building

    @staticmethod
    def from_terms(statements: DataFrame, identity: str = "rdf") -> TripleStore:
        """From structs s, p, o (kind, lex, lang, dt). Statements with a null part are left out, repeats are one fact. The
        dictionary is one distinct over the terms; encoding is a hash, so no statement is joined with it."""
        if identity not in ("rdf", "lexical"):
            raise ValueError(f"unknown identity {identity}")
        whole = statements.where(" AND ".join(f"{c}.lex IS NOT NULL AND {c}.kind IS NOT NULL" for c in "spo"))
        ident = {c: term_id(*(F.col(f"{c}.{f}") for f in TERM_FIELDS), identity) for c in "spo"}
        none = F.lit(None).cast("int")
        triples = whole.select(*(ident[c].alias(c) for c in "spo")).distinct().select("s", "p", "o", none.alias("s_part"), none.alias("o_part"))
        # Terms with the same id have the same parts once tags are in lower case and xsd:string is left out.
        empty = lambda c: F.when(c != "", c)
        part = {
            "kind": lambda c: F.col(f"{c}.kind"),
            "lex": lambda c: F.col(f"{c}.lex"),
            "lang": lambda c: empty(F.lower(F.col(f"{c}.lang").cast("string"))),
            "dt": lambda c: F.when(F.col(f"{c}.dt") != XSD + "string", empty(F.col(f"{c}.dt").cast("string"))),
        }
        each = whole.select(F.explode(F.array(*(F.struct(ident[c].alias("id"), *(part[f](c).alias(f) for f in TERM_FIELDS)) for c in "spo"))).alias("t")).select("t.*")
        if identity == "rdf":
            terms = each.distinct()  # unlike a minimum over texts, a hash aggregation without a sort
        else:
            terms = each.groupBy("id").agg(F.min(F.struct(*TERM_FIELDS)).alias("t")).select("id", "t.*")
        return TripleStore(triples, terms, identity)

    @staticmethod
    def from_encoded(triples: DataFrame, terms: DataFrame) -> TripleStore:
        """From facts that are encoded already, with a dictionary of any ids. Facts with a null part are left out."""
        columns = set(triples.columns)
        parts = [F.max(c).alias(c) if c in columns else F.max(F.lit(None).cast("int")).alias(c) for c in ("s_part", "o_part")]
        facts = triples.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").groupBy("s", "p", "o").agg(*parts)
        return TripleStore(facts, terms.select("id", *TERM_FIELDS), hashed=False)

    def with_parts(self, parts: DataFrame) -> TripleStore:
        """Assigns graph partitions from (id, part); objects without one, as literals, take their subject's."""
        own = parts.where("id IS NOT NULL").groupBy("id").agg(F.min("part").cast("int").alias("part"))
        s, o = own.toDF("s", "ps"), own.toDF("o", "po")
        facts = self.triples.select("s", "p", "o").join(s, "s", "left").join(o, "o", "left").select("s", "p", "o", F.col("ps").alias("s_part"), F.coalesce("po", "ps").alias("o_part"))
        return TripleStore(facts, self.terms, self.identity, self.hashed)

    def check(self) -> None:
        """Raises ValueError if two terms share an id."""
        clash = self.terms.groupBy("id").agg(F.count_distinct("kind", "lex", F.coalesce("lang", F.lit("")), F.coalesce("dt", F.lit(""))).alias("n")).where("n > 1")
        if self.identity == "rdf" and clash.limit(1).count():
            raise ValueError("different terms share an id")

    # access

    def id_of(self, t: Term) -> Column:
        """The id of a constant; null if the dictionary of given ids hasn't got it, which makes the pattern empty."""
        if self.hashed:
            return term_id(*(F.lit(getattr(t, f)).cast("string") for f in TERM_FIELDS), self.identity)
        return F.lit(self._ids.get(t)).cast("long")

    def look_up(self, constants: set[Term]) -> None:
        """Fetches the ids of constants in one job, where ids aren't hashes."""
        new = [t for t in constants if t not in self._ids]
        if self.hashed or not new:
            return
        found = self.terms.where(F.col("lex").isin([t.lex for t in new])).collect()
        norm = lambda k, x, lang, dt: (k, x, (lang or "").lower(), dt or "")
        ids = {norm(r["kind"], r["lex"], r["lang"], r["dt"]): r["id"] for r in found}
        for t in new:
            self._ids[t] = ids.get(norm(t.kind, t.lex, t.lang, t.dt))

    def scan(self, object_bound: bool = False) -> DataFrame:
        """The layout that suits the access: sorted by object where the object is bound and the subject isn't."""
        return self.by_object if object_bound and self.by_object is not None else self.triples

    # persistence

    def save(self, path: str, buckets: int | None = None) -> TripleStore:
        """Writes the facts in two layouts, one by subject, one by object, and the dictionary by id, and returns the stored store.

        A layout is in buckets, so that joins on its key need no exchange; the dictionary has as many. Within a bucket the
        predicate comes first in order, so that row groups can be skipped. Where one subject (or object) holds more than
        ``MAX_SKEW`` times a bucket's share of the facts, its layout is in ranges over the whole fact instead: a hot key is
        then in several files, and its joins are left to adaptive execution. Statistics and the summary are written beside."""
        n = self.triples.count()
        buckets = buckets or min(4096, max(8, -(-n // 1_000_000)))
        kinds = {}
        for name, keys in LAYOUTS.items():
            top = self.triples.groupBy(keys[0]).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
            kinds[name] = buckets if top * buckets <= MAX_SKEW * n else 0
            self._write(self.triples, f"{path}/{name}", keys, (keys[1], keys[0], keys[2]), kinds[name])
        self._write(self.terms, f"{path}/terms", ("id",), ("id",), buckets)
        kinds["terms"] = buckets
        for name, df in (("predicate_stats", self.predicate_stats), ("join_stats", self.join_stats), ("summary", self.summary)):
            if df is not None:
                df.write.mode("overwrite").parquet(f"{path}/{name}")
        # Written last: a folder with it is whole.
        about = [(self.identity, self.hashed, *(kinds[x] for x in TABLES))]
        self.spark.createDataFrame(about, "identity string, hashed boolean, " + ", ".join(f"{x} int" for x in TABLES)).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        return TripleStore.load(self.spark, path)

    @staticmethod
    def _write(df: DataFrame, path: str, keys: tuple[str, ...], order: tuple[str, ...], buckets: int) -> None:
        if not buckets:
            df.repartitionByRange(*keys).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
            return
        name = _table(path)
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        df.repartition(buckets, keys[0]).write.mode("overwrite").bucketBy(buckets, keys[0]).sortBy(*order).option("path", path).saveAsTable(name)

    @staticmethod
    def load(spark: SparkSession, path: str) -> TripleStore:
        about = spark.read.parquet(f"{path}/about").first()
        optional = {name: spark.read.parquet(f"{path}/{name}") for name in ("predicate_stats", "join_stats", "summary") if exists(spark, f"{path}/{name}")}

        def table(name: str, key: str, order: tuple[str, ...]) -> DataFrame:
            files = spark.read.parquet(f"{path}/{name}")
            if not about[name]:
                return files
            # Buckets are known to Spark by way of a table over the files.
            view = _table(f"{path}/{name}")
            columns = ", ".join(f"`{c}` {k}" for c, k in files.dtypes)
            spark.sql(f"DROP TABLE IF EXISTS {view}")
            spark.sql(f"CREATE TABLE {view} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {about[name]} BUCKETS LOCATION '{path}/{name}'")
            return spark.table(view)

        facts = {name: table(name, keys[0], (keys[1], keys[0], keys[2])) for name, keys in LAYOUTS.items()}
        return TripleStore(facts["by_subject"], table("terms", "id", ("id",)), about["identity"], about["hashed"], facts["by_object"], path=path, **optional)

    def frozen(self) -> TripleStore:
        """The same store with its facts and dictionary written to the shared folder once."""
        return TripleStore(stored(self.triples, "triples"), stored(self.terms, "terms"), self.identity, self.hashed, skipped=self.skipped)


#: Layouts by name, with the order of their ranges; buckets are by the first.
LAYOUTS = {"by_subject": ("s", "p", "o"), "by_object": ("o", "p", "s")}
TABLES = (*LAYOUTS, "terms")
MAX_SKEW = 4


def _table(path: str) -> str:
    return f"triples_{md5(path.encode()).hexdigest()}"
