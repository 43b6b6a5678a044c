"""The registered queries take the paths that a very large table takes: several bins, shards and ranges at the smallest scales."""

import os

import pytest

from tripleloom.operators.compaction import compact
from tripleloom.operators.wide import range_bits
from tripleloom.runtime import fresh_path, read, scratch, stored

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_compaction_has_bins_and_shards(spark):
    done = compact(read(spark, SF, "nt_files"))
    assert done.bins.select("bin").distinct().count() >= 20 and done.bins.select("shard").distinct().count() >= 3
    assert done.checks["copies"] > done.checks["rows"] == spark.read.parquet(done.path).count()
    fills = done.bins.groupBy("bin").agg({"n_bytes": "sum", "file_id": "count"}).where("`count(file_id)` > 1")
    assert fills.where(f"`sum(n_bytes)` > {done.capacity}").count() == 0  # only a larger file has a larger bin


@pytest.mark.parametrize("subjects,attributes,at_least", [(3_005, 22, 8), (30_004, 22, 8), (3_000_000, 22, 92), (3_000_000, 2_000, 1_464)])
def test_wide_tables_have_ranges(subjects, attributes, at_least):
    bits = range_bits(subjects, attributes)
    assert -(-subjects >> bits) >= at_least or -(-subjects // (1 << bits)) >= at_least
    assert attributes << bits <= 1 << 22


def test_scratch_removes_what_was_written(spark):
    with scratch():
        inner = stored(spark.range(3), "x")
        path = inner.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
        assert os.path.isdir(path)
        kept = fresh_path(spark, "kept", keep=True)
        spark.range(2).write.parquet(kept)
    assert not os.path.isdir(path) and spark.read.parquet(kept).count() == 2
