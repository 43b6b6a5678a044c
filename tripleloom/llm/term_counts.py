"""Frequency of every distinct term, kept up to date by signed deltas.

State under one folder, all of it in runs of signed changes that are only ever added to:
pairs/<run>/bucket=<b>   role, term, record, delta
terms/<run>/bucket=<b>   role, term, occurrences, records (changes)
records/<run>/bucket=<b> record, delta
_committed/<n>.json      the runs that count, the number of buckets, the roles; a change is visible once its file is there
Buckets are by hash of all keys of a table, so that a hot term is in all of them and none is larger than the others; their
number follows from the size of the first change set, and anew from that of the state whenever runs are merged. It is the
hash by which Spark places the groups of an aggregation, so a run is aggregated and written with one exchange.
A change set is first aggregated to pairs; the pairs' earlier counts, read from the touched buckets only, tell which records
a term gains or loses."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.runtime import delete

MAX_BUCKETS = 1 << 15


class TermCounts:
    """Occurrence and record counts of terms. roles: role -> column of the changed rows; record: their record's column.

    What is under ``path`` already is taken up; ValueError where it was made with other roles or types. Null terms and rows
    with a null record are left out. A row that comes twice occurs twice. Roles are counted apart. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, roles: Mapping[str, str], record: str, term_type: str = "long", record_type: str = "long", bucket_rows: int = 250_000, least_buckets: int = 8):
        self.spark, self.path, self.roles, self.record = spark, path.rstrip("/"), dict(roles), record
        self.bucket_rows, self.least_buckets = bucket_rows, least_buckets
        self.schemas = {"pairs": f"role string, term {term_type}, record {record_type}, delta long, bucket int", "terms": f"role string, term {term_type}, occurrences long, records long, bucket int", "records": f"record {record_type}, delta long, bucket int"}
        self.keys = {"pairs": ["role", "term", "record"], "terms": ["role", "term"], "records": ["record"]}
        self.about = {"roles": sorted(self.roles), "term_type": term_type, "record_type": record_type}
        self.version, self.buckets, self.runs = 0, 0, []
        self._open()

    # what is committed

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        hp = jvm.org.apache.hadoop.fs.Path(path)
        return hp.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hp

    def _open(self) -> None:
        fs, folder = self._fs(f"{self.path}/_committed")
        if not fs.exists(folder):
            return
        found = [int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.endswith(".json") and n[:-5].isdigit()]
        if not found:
            return
        self.version = max(found)
        state = json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/_committed/{self.version}.json").collect()))
        if state["about"] != self.about:
            raise ValueError(f"{self.path} has counts of {state['about']}")
        self.buckets, self.runs = state["buckets"], state["runs"]

    def _commit(self, runs: list[str], buckets: int) -> None:
        """Makes the runs the state, by one rename of a finished file. FileExistsError if someone else has committed."""
        fs, target = self._fs(f"{self.path}/_committed/{self.version + 1}.json")
        _, draft = self._fs(f"{self.path}/_committed/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"about": self.about, "buckets": buckets, "runs": runs}).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise FileExistsError(target.toString())
        self.version, self.runs, self.buckets = self.version + 1, list(runs), buckets

    def _state(self, name: str) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], self.schemas[name])
        return reduce(DataFrame.unionByName, (self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}/{r}") for r in self.runs))

    # writing

    def _buckets_for(self, rows: int) -> int:
        wanted = max(self.least_buckets, -(-rows // self.bucket_rows))
        return min(MAX_BUCKETS, 1 << (wanted - 1).bit_length())

    @contextmanager
    def _partitions(self, n: int) -> Iterator[None]:
        before = self.spark.conf.get("spark.sql.shuffle.partitions")
        self.spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            yield
        finally:
            self.spark.conf.set("spark.sql.shuffle.partitions", before)

    def _write(self, rows: DataFrame, name: str, sums: dict[str, Column], keep: str, run: str, buckets: int) -> DataFrame:
        """Sums rows by the keys and writes a run. Rows of a hot key are combined where they are; the exchange of the
        aggregation places a key in the partition of its bucket, so that a bucket is one file."""
        keys, path = self.keys[name], f"{self.path}/{name}/{run}"
        placed = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in sums.items())).where(keep).withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        with self._partitions(buckets):
            placed.write.partitionBy("bucket").parquet(path)
        extra = ", least long" if "least" in sums else ""
        return self.spark.read.schema(self.schemas[name].replace(", bucket int", f"{extra}, bucket int")).parquet(path)

    def _drop(self, runs: list[str]) -> None:
        for name in self.schemas:
            for r in runs:
                delete(self.spark, f"{self.path}/{name}/{r}")

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Merges a change set; a changed row is removed as it was and added as it is. A failed update leaves the counts
        as they were and can be repeated. ValueError where more is removed than there is."""
        sets = [(df, sign) for df, sign in ((added, 1), (removed, -1)) if df is not None]
        if not sets:
            return
        cols = {**{f"_{r}": c for r, c in self.roles.items()}, "_record": self.record}
        rows = reduce(DataFrame.union, (df.select(*(F.col(f"`{c}`").alias(a) for a, c in cols.items())).withColumn("_sign", F.lit(s)) for df, s in sets)).where(F.col("_record").isNotNull())
        buckets = self.buckets or self._buckets_for(rows.count() * len(self.roles))
        run = uuid.uuid4().hex
        try:
            self._apply(rows, run, buckets, removed is not None)
            self._commit([*self.runs, run], buckets)
        except BaseException:
            self._drop([run])
            raise

    def _apply(self, rows: DataFrame, run: str, buckets: int, shrinks: bool) -> None:
        role = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"_{r}").alias("term")) for r in self.roles))).alias("t")
        pairs = rows.select(role, F.col("_record").alias("record"), "_sign").where(F.col("t.term").isNotNull()).select("t.role", "t.term", "record", "_sign")
        deltas = self._write(pairs, "pairs", {"delta": F.sum("_sign")}, "delta <> 0", run, buckets)
        self._write(rows.select(F.col("_record").alias("record"), "_sign"), "records", {"delta": F.sum("_sign")}, "delta <> 0", run, buckets)
        held = F.lit(0).cast("long")
        if self.runs:
            keys = self.keys["pairs"]
            touched = [r[0] for r in deltas.select("bucket").distinct().collect()]
            before = self._state("pairs").where(F.col("bucket").isin(touched)).withColumnRenamed("delta", "held")
            before = before.join(deltas.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.sum("held").alias("held"))
            deltas, held = deltas.join(before, keys, "left"), F.coalesce("held", held)
        deltas = deltas.select("role", "term", "delta", held.alias("held"))
        after = F.col("held") + F.col("delta")
        gained = (after > 0).cast("long") - (F.col("held") > 0).cast("long")
        terms = self._write(deltas, "terms", {"occurrences": F.sum("delta"), "records": F.sum(gained), "least": F.min(after)}, "true", run, buckets)
        if shrinks and terms.where("least < 0").limit(1).count():
            raise ValueError("more is removed than there is")

    def merge_runs(self) -> None:
        """Replaces all runs by one, once there are many, in as many buckets as their size asks for. The old runs are
        deleted once the new one is committed; a merge that ends before leaves everything as it was."""
        if not self.runs:
            return
        run, old = uuid.uuid4().hex, self.runs
        left = self._state("pairs").groupBy(*self.keys["pairs"]).agg(F.sum("delta").alias("delta")).where("delta <> 0")
        buckets = self._buckets_for(left.count())
        try:
            for name, sums in (("pairs", ["delta"]), ("terms", ["occurrences", "records"]), ("records", ["delta"])):
                self._write(self._state(name), name, {c: F.sum(c) for c in sums}, " OR ".join(f"{c} <> 0" for c in sums), run, buckets)
            self._commit([run], buckets)
        except BaseException:
            self._drop([run])
            raise
        self._drop(old)

    # reading

    def counts(self) -> DataFrame:
        """role, term, occurrences, records of the terms that occur."""
        sums = self._state("terms").groupBy("role", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        return sums.where("occurrences > 0")

    def n_records(self) -> int:
        """Number of distinct records that have any row, those with null terms too."""
        return self._state("records").groupBy("record").agg(F.sum("delta").alias("n")).where("n > 0").count()

    def marked(self, rare_below: int, common_share: float) -> DataFrame:
        """The counts with band: rare (fewer records than ``rare_below``), common (more than the share of all records), else null; rare
        goes before common."""
        n = self.n_records()
        band = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_share * n, "common")
        return self.counts().withColumn("band", band)
