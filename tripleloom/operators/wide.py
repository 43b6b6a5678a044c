"""Attribute-value rows into wide tables by positional stitching.

Each subject gets a global ordinal; each attribute is written as a typed column whose entries carry their position
within ordinal ranges; the wide rows of a range are put together by position, without one join for each attribute."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.xsd import SPARK_TYPE, in_lexical_space, typed
from tripleloom.operators.compaction import WHITE
from tripleloom.runtime import broadcastable, fresh_path, stored

#: Attributes are columns, so their number is bounded by what one table can have.
MAX_ATTRIBUTES = 2_000
#: Subjects of a range: no more than 2^15, and as many ranges as this where there are fewer.
MAX_RANGE_BITS = 15
LEAST_RANGES = 32
#: Cells of a range, filled or not: a task's memory.
MAX_CELLS = 1 << 22


@dataclass(frozen=True)
class Attribute:
    name: str
    column: str
    col_type: str


def ordinals(keys: DataFrame, key: str) -> DataFrame:
    """key, ordinal: numbers the distinct non-null keys from 0 in their order. One range partitioning; the driver gets
    one count for each partition."""
    ranged = keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key)
    placed = stored(ranged.select(key, F.monotonically_increasing_id().alias("place")), "ordinals")
    part = F.shiftright("place", 33).cast("int")
    held = {row["part"]: row["count"] for row in placed.groupBy(part.alias("part")).count().collect()}
    starts, total = [], 0
    for i in range(max(held, default=0) + 1):
        starts.append(total)
        total += held.get(i, 0)
    start = F.array(*(F.lit(x).cast("long") for x in starts))
    return placed.select(key, (start[part] + F.col("place").bitwiseAND((1 << 33) - 1)).alias("ordinal"))


def attributes(attrs: DataFrame) -> list[Attribute]:
    """The distinct attributes in name order. Names equal to ``s`` or ``filled``, or equal to another but for case, get a number as their
    column's name, as columns differ in more than case. ValueError: an attribute of two types or of an unknown one, too many attributes."""
    rows = attrs.where(F.col("p").isNotNull() & F.col("attr").isNotNull()).select("attr", "col_type").distinct()
    if not broadcastable(rows, MAX_ATTRIBUTES):
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    out, taken = [], {"s", "filled"}
    for row in sorted(rows.collect()):
        if row["col_type"] not in SPARK_TYPE:
            raise ValueError(f"{row['attr']}: unknown type {row['col_type']}")
        if out and out[-1].name == row["attr"]:
            raise ValueError(f"{row['attr']} has more than one type")
        column, n = row["attr"], 2
        while column.lower() in taken:
            column, n = f"{row['attr']}_{n}", n + 1
        taken.add(column.lower())
        out.append(Attribute(row["attr"], column, row["col_type"]))
    return out


def slots(attrs: DataFrame, names: list[Attribute]) -> DataFrame:
    """p, slot (the attribute's place in ``names``), col_type: one row for each predicate of an attribute."""
    spark = attrs.sparkSession
    table = spark.createDataFrame([(a.name, i, a.col_type) for i, a in enumerate(names)], "attr string, slot int, col_type string")
    by_p = attrs.where(F.col("p").isNotNull()).select("p", "attr").distinct().join(F.broadcast(table), "attr").select("p", "slot", "col_type")
    return F.broadcast(by_p) if broadcastable(by_p, 100_000) else by_p


def fitting_cells(triples: DataFrame, terms: DataFrame, by_p: DataFrame) -> DataFrame:
    """s, slot, col_type, lex: the cells that have a fitting object, of several fitting texts the smallest. White space at both
    ends of a text is removed first."""
    facts = triples.select("s", "p", "o").where(F.col("s").isNotNull() & F.col("o").isNotNull()).join(by_p, "p").groupBy("s", "slot", "col_type", "o").agg(F.lit(1).alias("one"))
    words = terms.select(F.col("id").alias("o"), "kind", F.btrim("lex", F.lit(WHITE)).alias("lex")).where(F.col("lex").isNotNull())
    literal = F.col("kind") == "L"
    fits = F.when(F.col("col_type") == "iri", F.col("kind").isin("I", "B")).when(F.col("col_type") == "string", literal & (F.col("lex") != ""))
    for t in SPARK_TYPE:
        if t not in ("iri", "string"):
            fits = fits.when(F.col("col_type") == t, literal & in_lexical_space(F.col("lex"), "dateTime" if t == "datetime" else t))
    return facts.join(words, "o").where(fits).groupBy("s", "slot", "col_type").agg(F.min("lex").alias("lex"))


def range_bits(n_subjects: int, n_attributes: int) -> int:
    """Ranges are of 2 to this power subjects."""
    return min(MAX_RANGE_BITS, (MAX_CELLS // n_attributes).bit_length() - 1, max(1, n_subjects // LEAST_RANGES).bit_length())


def wide_table(triples: DataFrame, terms: DataFrame, attrs: DataFrame) -> tuple[DataFrame, list[Attribute]]:
    """One row for each non-null subject of ``triples``: s, a typed column for each attribute, and ``filled``, the
    names of the attributes that have a fitting object.

    A fitting value beyond the range of its column's type is null in the column, but its attribute is in ``filled``.
    Of several fitting objects the one whose text is the smallest is taken. Subjects without any have a row of nulls.
    triples needs s, p, o; terms id, kind, lex; attrs p, attr, col_type; other columns are ignored. Repeated rows change
    nothing; empty tables give no rows (no triples) or only subjects (no terms or no attributes)."""
    spark = triples.sparkSession
    names = attributes(attrs)
    subjects = ordinals(triples, "s")
    if not names:
        return subjects.select("s", F.array().cast("array<string>").alias("filled")), names
    bits = range_bits(subjects.count(), len(names))
    rng, pos = F.shiftright("ordinal", bits).alias("rng"), F.col("ordinal").bitwiseAND((1 << bits) - 1).cast("int").alias("pos")
    types = sorted({a.col_type for a in names})
    cells = fitting_cells(triples, terms, slots(attrs, names)).join(subjects, "s")
    value = [F.when(F.col("col_type") == t, typed(F.col("lex"), t)).alias(f"v_{t}") for t in types]
    # A column of each type; in it an attribute's values are together, by range and position.
    columns = fresh_path(spark, "columns")
    cells.select(rng, pos, "slot", *value, "col_type").repartition("rng").sortWithinPartitions("col_type", "rng", "slot", "pos").write.partitionBy("col_type").parquet(columns)
    schema = "rng long, pos int, slot int, " + ", ".join(f"v_{t} {SPARK_TYPE[t]}" for t in types)
    read = spark.read.schema(schema).parquet(columns).select("rng", "pos", "slot", *(f"v_{t}" for t in types))
    parts = read.withColumn("s", F.lit(None).cast("long")).unionByName(subjects.select(rng, pos, F.lit(-1).alias("slot"), "s"), allowMissingColumns=True)
    made = parts.groupBy("rng").applyInArrow(_stitcher(names), "s long, " + ", ".join(f"c{i} {SPARK_TYPE[a.col_type]}" for i, a in enumerate(names)) + ", filled array<string>")
    return made.select("s", *(F.col(f"c{i}").alias(a.column) for i, a in enumerate(names)), "filled"), names


def _stitcher(names: list[Attribute]):
    labels, kinds = [a.name for a in names], [a.col_type for a in names]

    def stitch(part: pa.Table) -> pa.Table:
        """The rows of a range: each attribute's values are laid down by their positions."""
        order = np.argsort(part["slot"].to_numpy(), kind="stable")
        slot, place = part["slot"].to_numpy()[order], part["pos"].to_numpy()[order]
        edges = np.searchsorted(slot, np.arange(-1, len(names) + 1))
        size = int(edges[1] - edges[0])  # positions of a range have no gaps
        at = np.full((len(names) + 1, size), -1, dtype=np.int64)
        at[slot + 1, place] = order
        out = []
        for i, values in enumerate([part["s"], *(part[f"v_{k}"] for k in kinds)]):
            if edges[i] == edges[i + 1]:
                out.append(pa.nulls(size, values.type))
            else:
                out.append(values.take(pa.array(at[i], mask=at[i] < 0)).combine_chunks())
        row, which = np.nonzero((at[1:] >= 0).T)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=size))]).astype(np.int32)
        filled = pa.ListArray.from_arrays(pa.array(ends), pa.array(labels, pa.string()).take(pa.array(which)))
        return pa.table([*out, filled], names=["s", *(f"c{i}" for i in range(len(names))), "filled"])

    return stitch
