"""The registered queries take the paths that a very large table takes: merges, rounds and deliveries at the smallest scales."""

import os

import pytest

from tripleloom.llm import queries, set_sketch
from tripleloom.llm.packing import packed, token_counts
from tripleloom.runtime import read, stored

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def test_hot_days_are_merged_and_sets_are_registers(spark, monkeypatch):
    parts = []
    real = set_sketch.merged
    monkeypatch.setattr(set_sketch, "merged", lambda df, *a: parts.append(df.count()) or real(df, *a))
    sketches = stored(queries._sketches(spark, SF), "sketches")
    assert parts[0] > 0  # parts of hot days that were merged by maximum
    dense = sketches.where("registers IS NOT NULL")
    assert dense.count() > 300 and dense.where("hashes IS NOT NULL").count() == 0


def test_packing_has_rounds(spark):
    sizes = stored(token_counts(read(spark, SF, "documents"), "doc_id", "text"), "sizes")
    done = packed(sizes, "key", "n_tokens", queries.CAPACITY)
    assert [r[0] for r in done.rounds] == [16, 4, 1]


def test_counts_come_from_three_deliveries(spark):
    counts = queries._term_counts(spark, SF)
    assert counts.version == 3 and len(counts.runs) == 3 and counts.buckets >= 8
