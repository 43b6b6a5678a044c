"""Session-level helpers: the shared work folder, tables that cut lineage, sizes that were really measured."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)
_local_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, from ``spark.checkpoint.dir``; only where that is unset (tests) one of our own."""
    ready(spark)
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tripleloom-")
    return _local_dirs[app]


def ready(spark: SparkSession) -> None:
    """Tells Python workers where this package is, as they import its functions by name. Every operator does so before it makes
    any; where the package is installed, it changes nothing."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes what is written to the work folder within the block when it ends. Results must have been used up or written
    elsewhere by then."""
    n = len(_written)
    try:
        yield
    finally:
        for spark, path in _written[n:]:
            delete(spark, path)
        del _written[n:]


def fresh_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A new path under the work folder; what is written there is removed when the driver ends, or, unless ``keep``, with its
    ``scratch`` block."""
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    (_kept if keep else _written).append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of any Hadoop file system, if it is there."""
    jvm = spark.sparkContext._jvm
    hp = jvm.org.apache.hadoop.fs.Path(path)
    hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


@atexit.register
def _clean() -> None:
    for spark, path in [*_written, *_kept]:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended, nothing more can be done
            pass
    for own in _local_dirs.values():
        shutil.rmtree(own.removeprefix("file://"), ignore_errors=True)


def stored(df: DataFrame, tag: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Writes the rows to the shared folder and reads them again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcastable(df: DataFrame, max_rows: int) -> bool:
    """Whether the rows are no more than ``max_rows``, found by counting at most one row more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread(df: DataFrame) -> DataFrame:
    """Spreads an input over all cores before costly work on each row where Spark would plan fewer splits than there are cores,
    as it does below its cost of opening a file for each core. Larger inputs aren't shuffled."""
    ready(df.sparkSession)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    opening = df.sparkSession._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    return df.repartition(cores) if size < cores * opening else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
