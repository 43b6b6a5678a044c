"""Far too many small files: frozen manifest, first-fit decreasing, rewrite by bin, verification, atomic commit.

Duplicates are found by hashes of the records; the records themselves are moved once, to the task that writes their bin."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.runtime import delete, fresh_path, stored

#: Lines of a file that are packed as one item: a huge file is several items, so no bin and no task holds it whole.
CHUNK_LINES = 100_000
#: Every white space character.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@dataclass(frozen=True)
class Compaction:
    """manifest: file_id, chunk, n_bytes, n_records, checksum of what was found before anything else was done. bins: file_id,
    chunk, n_bytes, bin. checks: distinct records and checksum of what was written, copies in the source."""

    path: str
    manifest: DataFrame
    bins: DataFrame
    checks: dict[str, int]
    capacity: int


def records(files: DataFrame, file_id: str = "file_id", body: str = "body") -> DataFrame:
    """file_id, line_no, record of each line that is neither blank nor a comment, white space at both ends removed.

    Lines are counted from 1 with every line counted; null and empty bodies have none."""
    lines = files.select(F.col(f"`{file_id}`").alias("file_id"), F.posexplode(F.split(F.col(f"`{body}`"), "\n")).alias("at", "line"))
    cut = lines.select("file_id", (F.col("at") + 1).alias("line_no"), F.btrim("line", F.lit(WHITE)).alias("record"))
    return cut.where((F.col("record") != "") & ~F.col("record").startswith("#"))


#: Two differently seeded hashes and the length tell records apart.
def _hashes(record: Column) -> tuple[Column, Column]:
    return F.xxhash64(record), F.xxhash64(F.lit(0x5EED), record, F.octet_length(record))


_FILE_ID = "decimal(38,0)"
#: Stands for a null file_id.
_BEYOND = Decimal(1 << 63)


def first_places(rows: DataFrame) -> DataFrame:
    """hash, hash2, file_id, line_no, copies of each distinct record, with its first place: the smallest file_id (null last), in it the
    smallest line_no. Only hashes and places are shuffled, counted before where they are."""
    hash1, hash2 = _hashes(F.col("record"))
    # One number for the place keeps the minimum in a hash aggregation; null is beyond every file_id.
    lines = 1 << 31
    place = F.coalesce(F.col("file_id").cast(_FILE_ID), F.lit(_BEYOND).cast(_FILE_ID)) * F.lit(lines).cast("decimal(11,0)") + F.col("line_no").cast("decimal(11,0)")
    got = rows.select(hash1.alias("hash"), hash2.alias("hash2"), place.cast(_FILE_ID).alias("place")).groupBy("hash", "hash2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
    line = F.pmod("place", F.lit(lines).cast(_FILE_ID))
    file = ((F.col("place") - line) / F.lit(lines)).cast(_FILE_ID)
    return got.select("hash", "hash2", F.when(file < F.lit(_BEYOND).cast(_FILE_ID), file.cast("long")).alias("file_id"), line.cast("int").alias("line_no"), "copies")


def frozen_manifest(files: DataFrame, file_id: str = "file_id", body: str = "body") -> DataFrame:
    """file_id, chunk, n_bytes, n_records, checksum: what each file holds, in chunks of ``CHUNK_LINES`` lines, with all repeats.

    Bytes are those of the chunk's records with a line end each. The checksum is the sum of the records' hashes. A file_id that comes
    twice is one entry. Files without records have none."""
    lines = files.select(F.col(f"`{file_id}`").alias("file_id"), F.posexplode(F.split(F.col(f"`{body}`"), "\n")).alias("at", "line"))
    kept = lines.select("file_id", F.floor((F.col("at") + 1) / CHUNK_LINES).alias("chunk"), F.btrim("line", F.lit(WHITE)).alias("record")).where("record <> '' AND substring(record, 1, 1) <> '#'")
    return kept.groupBy("file_id", "chunk").agg(F.sum(F.octet_length("record") + 1).cast("long").alias("n_bytes"), F.count(F.lit(1)).alias("n_records"), _total(F.xxhash64("record")).alias("checksum"))


def _total(hashes: Column) -> Column:
    """Sum that doesn't overflow, whatever the number of rows."""
    return F.coalesce(F.sum(hashes.cast("decimal(28,0)")), F.lit(0)).cast("decimal(38,0)")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; items above the capacity get a bin of their own. A max-tree over the bins' room finds the
    first bin that fits in logarithmic time."""
    n = len(sizes)
    width = 1 << max(0, (max(n, 1) - 1).bit_length())
    room = np.zeros(2 * width, dtype=np.int64)
    room[width : width + n] = capacity
    for i in range(width - 1, 0, -1):
        room[i] = max(room[2 * i], room[2 * i + 1])
    room = room.tolist()
    out = np.empty(n, dtype=np.int64)
    for item in np.argsort(-sizes, kind="stable"):
        size, i = int(min(sizes[item], capacity)), 1
        while i < width:
            i *= 2
            if room[i] < size:
                i += 1
        out[item] = i - width
        room[i] = 0 if sizes[item] >= capacity else room[i] - size
        while i > 1:
            i //= 2
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
    return out


def shards_for(manifest: DataFrame, capacity: int, shard_bins: int, shard_files: int = 50_000) -> int:
    """Number of shards of about ``shard_bins`` bins and no more than about ``shard_files`` items."""
    n, total = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return max(1, -(-n // shard_files), min(n, -(-total // (capacity * shard_bins))))


def pack(manifest: DataFrame, capacity: int, shards: int) -> DataFrame:
    """file_id, chunk, n_bytes, shard, bin. Items of a shard are packed by first-fit decreasing in one task: no task's share
    grows with the table, at the cost of one bin that isn't full for each shard."""

    def ffd(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_bytes", "file_id", "chunk"], ascending=[False, True, True], kind="stable")
        return pdf.assign(bin=pdf["shard"].astype("int64") * (1 << 32) + first_fit_decreasing(pdf["n_bytes"].to_numpy(np.int64), capacity))[["file_id", "chunk", "n_bytes", "shard", "bin"]]

    sharded = manifest.select("file_id", "chunk", "n_bytes", F.pmod(F.xxhash64("file_id", "chunk"), F.lit(shards)).alias("shard"))
    return sharded.groupBy("shard").applyInPandas(ffd, "file_id long, chunk long, n_bytes long, shard long, bin long")


def compact(files: DataFrame, capacity: int = 128 << 20, least_files: int = 24, shard_bins: int = 8, path: str | None = None, file_id: str = "file_id", body: str = "body") -> Compaction:
    """Consolidates the records of many small files into few files of about ``capacity`` bytes, each record once.

    1. The manifest is frozen in a table: each file's chunks with bytes, records and checksum. Where the whole is less than
       ``least_files`` times the capacity, the capacity is lowered to give that many files, so that they can be read at once.
    2. Files (and chunks of huge ones) are packed into bins by first-fit decreasing, in shards of ``shard_bins`` bins.
    3. The first place of each distinct record is found by hashes. Bins hold what their files' first places are; as repeats go,
       they may be less full than planned.
    4. Records are moved to their shard, those at first places are kept, and each bin becomes one Parquet file bin=<n>/ of
       file_id, line_no, record, in that order.
    5. Numbers and checksums must agree: the manifest's with the first places' and their copies, and those of the first places with
       what was written, read again. Only then one rename makes the folder visible under ``path``.
    RuntimeError, with nothing committed, where they differ: a record was lost, or a file changed after the freeze. An existing
    ``path`` isn't overwritten (FileExistsError). Files without records aren't in the result; an empty table gives a
    folder without files. Other columns of the input are ignored. A null file_id is packed like any other, a file_id that
    comes twice is one file of all its lines; of two records at one place both are kept."""
    spark = files.sparkSession
    manifest = stored(frozen_manifest(files, file_id, body), "manifest")
    n_records, checksum, n_bytes = manifest.agg(F.coalesce(F.sum("n_records"), F.lit(0)), _total(F.col("checksum")), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    capacity = max(1, min(capacity, math.ceil(n_bytes / least_files)))
    shards = shards_for(manifest, capacity, shard_bins)
    bins = stored(pack(manifest, capacity, shards), "bins")
    source = records(files, file_id, body)
    chunk = F.floor(F.col("line_no") / CHUNK_LINES).alias("chunk")
    first = stored(first_places(source), "places")
    found = first.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum((F.col("hash").cast("decimal(19,0)") * F.col("copies").cast("decimal(18,0)")).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)"), _total(F.xxhash64("file_id", "line_no", "hash"))).first()
    if (n_records, checksum) != (found[1], found[2]):
        raise RuntimeError(f"{n_records} records are in the manifest (checksum {checksum}), {found[1]} were read ({found[2]})")
    where = bins.select(F.col("file_id").alias("id"), F.col("chunk").alias("part"), "shard", "bin")
    chosen = first.select("*", chunk).join(where, F.col("file_id").eqNullSafe(F.col("id")) & (F.col("chunk") == F.col("part"))).select("shard", "bin", "file_id", "line_no", "hash", "hash2", F.lit(None).cast("string").alias("record"))
    hash1, hash2 = _hashes(F.col("record"))
    # The shard follows from the file and chunk alone, so records need no join before they are moved.
    shard = F.pmod(F.xxhash64("file_id", F.floor(F.col("line_no") / CHUNK_LINES)), F.lit(shards))
    moved = source.select(shard.alias("shard"), F.lit(None).cast("long").alias("bin"), "file_id", "line_no", hash1.alias("hash"), hash2.alias("hash2"), "record")
    both = chosen.unionByName(moved).repartition("shard")
    kept = both.groupBy("shard", "file_id", "line_no", "hash", "hash2").agg(F.max("bin").alias("bin"), F.first("record", ignorenulls=True).alias("record")).where("bin IS NOT NULL AND record IS NOT NULL")
    staging = fresh_path(spark, "staging")
    final = path or fresh_path(spark, "compacted")
    kept.select("file_id", "line_no", "record", "bin").sortWithinPartitions("bin", "file_id", "line_no").write.partitionBy("bin").parquet(staging)
    back = spark.read.schema(SCHEMA).parquet(staging)
    written = tuple(back.agg(F.count(F.lit(1)), _total(F.xxhash64("file_id", "line_no", F.xxhash64("record")))).first())
    if written != (found[0], found[3]):
        delete(spark, staging)
        raise RuntimeError(f"what was written differs from the source: {written} against {(found[0], found[3])}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    old, new = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(final)
    fs = new.getFileSystem(conf)
    if fs.exists(new) or not fs.rename(old, new):
        raise FileExistsError(final)
    return Compaction(final, manifest, bins, {"rows": written[0], "checksum": int(written[1]), "copies": n_records}, capacity)


SCHEMA = "file_id long, line_no int, record string, bin long"


def compacted(result: Compaction, spark) -> DataFrame:
    """The committed records: file_id, line_no, record, bin."""
    return spark.read.schema(SCHEMA).parquet(result.path)
