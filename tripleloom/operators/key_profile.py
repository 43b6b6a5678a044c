"""A few keys holding most records: value-frequency compression.

Rows are first counted by key *and* value, so that a hot key is spread over as many tasks as it has values and a hot
value shrinks to one row before any shuffle; exact per-key results are then derived from the weighted values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleloom.runtime import stored


def value_frequencies(df: DataFrame, keys: Mapping[str, str], value: str) -> DataFrame:
    """role, key, value, weight: how often each value comes with each key. keys: role -> column; all of one type.

    Null keys and null values are kept as a key and a value of their own; an empty input has no rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.col(f"`{c}`").alias("key")) for r, c in keys.items()))).alias("k")
    rows = df.select(F.col(f"`{value}`").alias("value"), pairs) if len(keys) > 1 else df.select(F.col(f"`{value}`").alias("value"), F.struct(*(x for r, c in keys.items() for x in (F.lit(r).alias("role"), F.col(f"`{c}`").alias("key")))).alias("k"))
    return rows.groupBy("k.role", "k.key", "value").agg(F.count(F.lit(1)).alias("weight"))


def key_totals(freq: DataFrame) -> DataFrame:
    """role, key, n_rows, n_distinct (null isn't a value), mode (the most frequent value, of ties the smallest; null only
    where there's no other) and mode_rows."""
    most = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))))
    return (
        freq.groupBy("role", "key")
        .agg(F.sum("weight").alias("n_rows"), F.count("value").alias("n_distinct"), most.alias("m"))
        .select("role", "key", "n_rows", "n_distinct", F.col("m.v").alias("mode"), (-F.col("m.w")).alias("mode_rows"))
    )


def key_percentiles(freq: DataFrame, points: Sequence[float]) -> DataFrame:
    """role, key, p<percent>…: exact discrete percentiles (the smallest value that has the share of the key's rows at or
    below it) of the non-null values; keys without such values have no row.

    The weighted values are range-partitioned by (role, key, value), so a hot key lies in many partitions; running sums
    are made within a partition and shifted by what the partitions before hold of the key, one row for each."""
    order = ["role", "key", "value"]
    ranged = freq.where(F.col("value").isNotNull()).repartitionByRange(*order).select(*order, "weight", F.spark_partition_id().alias("part"))
    ranged = stored(ranged, "ranged")
    held = ranged.groupBy("role", "key", "part").agg(F.sum("weight").alias("held"))
    of_key = Window.partitionBy("role", "key")
    held = held.select("role", "key", "part", (F.sum("held").over(of_key.orderBy("part")) - F.col("held")).alias("before"), F.sum("held").over(of_key).alias("total"))
    running = F.sum("weight").over(Window.partitionBy("role", "key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    mine = ranged.withColumn("running", running).alias("r").join(held.alias("h"), F.col("r.key").eqNullSafe(F.col("h.key")) & (F.col("r.role") == F.col("h.role")) & (F.col("r.part") == F.col("h.part")))
    upto = F.col("running") + F.col("before")
    rank = {p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("total"))) for p in points}
    hit = {p: (upto >= k) & (upto - F.col("weight") < k) for p, k in rank.items()}
    return (
        mine.where(_any(hit.values()))
        .select("r.role", "r.key", *(F.when(h, F.col("value")).alias(_name(p)) for p, h in hit.items()))
        .groupBy("role", "key")
        .agg(*(F.max(_name(p)).alias(_name(p)) for p in points))
    )


def _name(p: float) -> str:
    return f"p{p * 100:g}".replace(".", "_")


def _any(conditions):
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def key_profile(df: DataFrame, keys: Mapping[str, str], value: str, points: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Totals and percentiles of each key of each role in one row; percentiles are null for keys without values."""
    freq = stored(value_frequencies(df, keys, value), "frequencies")
    t, p = key_totals(freq).alias("t"), key_percentiles(freq, points).alias("p")
    return t.join(p, (F.col("t.role") == F.col("p.role")) & F.col("t.key").eqNullSafe(F.col("p.key")), "left").select("t.*", *(F.col(f"p.{_name(x)}") for x in points))


def hot_keys(df: DataFrame, keys: Mapping[str, str], value: str, share: float) -> DataFrame:
    """role, key, n_rows of the non-null keys that hold at least ``share`` of all rows."""
    totals = key_totals(value_frequencies(df, keys, value))
    return totals.where(F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share) * df.count())).select("role", "key", "n_rows")
