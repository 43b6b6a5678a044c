import random

import numpy as np
import pytest

from tripleloom.operators import compaction
from tripleloom.operators.compaction import compact, compacted, first_fit_decreasing, records


def naive_ffd(sizes, capacity):
    out, room = [0] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = min(sizes[i], capacity)
        for b, r in enumerate(room):
            if r >= size and (sizes[i] < capacity or r == capacity):
                break
        else:
            b = len(room)
            room.append(capacity)
        out[i] = b
        room[b] = 0 if sizes[i] >= capacity else room[b] - size
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 300])
def test_first_fit_decreasing(n):
    rng = random.Random(n)
    sizes = [rng.choice([0, 1, 5, 30, 99, 100, 101, 250, rng.randrange(100)]) for _ in range(n)]
    assert first_fit_decreasing(np.array(sizes, dtype=np.int64), 100).tolist() == naive_ffd(sizes, 100)


def brute(rows):
    first = {}
    for f, body in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for n, line in enumerate((body or "").split("\n"), 1):
            record = line.strip()
            if record and not record.startswith("#"):
                first.setdefault(record, (f, n))
    return sorted((f, n, r) for r, (f, n) in first.items())


def test_every_record_once_at_its_first_place(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["\n", "\r\n"]).join(rng.choice(["", "# c", " a ", "b\t", f"r{rng.randrange(60)}", "hot"]) for _ in range(rng.randrange(9)))) for i in range(1, 80)]
    rows += [(80, None), (81, ""), (5, "hot\nlate")]  # null, empty, an id that comes twice
    df = spark.createDataFrame(rows, "file_id long, body string").selectExpr("*", "1 AS line_no", "2 AS record", "3 AS bin")
    done = compact(df, capacity=64, shard_bins=3)
    got = sorted(tuple(r) for r in compacted(done, spark).select("file_id", "line_no", "record").collect())
    assert got == brute(rows)
    assert done.checks["rows"] == len(got)
    fill = {}
    for r in done.bins.collect():
        fill.setdefault(r["bin"], []).append(r["n_bytes"])
    assert all(sum(v) <= 64 or len(v) == 1 for v in fill.values())
    assert len(fill) >= 20 and done.bins.select("shard").distinct().count() >= 4
    assert len(compacted(done, spark).inputFiles()) == compacted(done, spark).select("bin").distinct().count()  # a file for each bin


def test_empty_table_null_ids_and_long_bodies(spark):
    assert compacted(compact(spark.createDataFrame([], "file_id long, body string")), spark).count() == 0
    long = "x" * 3_000_000
    rows = [(None, "a\nb"), (4, "b\n" + long), (4, "c")]
    got = {(r["file_id"], r["line_no"], len(r["record"])) for r in compacted(compact(spark.createDataFrame(rows, "file_id long, body string"), 1000), spark).collect()}
    assert got == {(None, 1, 1), (4, 1, 1), (4, 2, 3_000_000)} | {(4, 1, 1)}


def test_a_huge_file_is_several_items(spark, monkeypatch):
    monkeypatch.setattr(compaction, "CHUNK_LINES", 10)
    df = spark.createDataFrame([(1, "\n".join(f"r{i}" for i in range(95))), (2, "a\nr3\nb")], "file_id long, body string")
    done = compact(df, capacity=60, least_files=1)
    assert done.manifest.where("file_id = 1").count() == 10 and done.bins.select("bin").distinct().count() > 4
    got = sorted((r["file_id"], r["line_no"]) for r in compacted(done, spark).collect())
    assert got == [(1, i) for i in range(1, 96)] + [(2, 1), (2, 3)]


def test_commit_is_not_repeated(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "file_id long, body string")
    path = f"file://{tmp_path}/out"
    compact(df, path=path)
    with pytest.raises(FileExistsError):
        compact(df, path=path)
    assert spark.read.parquet(path).count() == 1


def test_records_number_every_line(spark):
    got = [tuple(r) for r in records(spark.createDataFrame([(1, "\n# x\r\n a \r\n\nb")], "file_id long, body string")).collect()]
    assert got == [(1, 3, "a"), (1, 5, "b")]


def test_a_small_table_gives_files_that_can_be_read_at_once(spark):
    files = spark.createDataFrame([(i, "\n".join(f"file {i} record {j}" for j in range(20))) for i in range(500)], "file_id long, body string")
    done = compact(files)
    assert done.checks["rows"] == 10_000 and 24 <= done.bins.select("bin").distinct().count() <= 28
    assert done.bins.select("shard").distinct().count() == 3


def test_lost_records_are_noticed(spark, monkeypatch, tmp_path):
    files = spark.createDataFrame([(i, f"a{i}\nb{i}\nhot") for i in range(50)], "file_id long, body string")
    whole = compaction.records
    monkeypatch.setattr(compaction, "records", lambda *a: whole(*a).where("record <> 'b7'"))
    with pytest.raises(RuntimeError, match="manifest"):
        compact(files, path=f"file://{tmp_path}/out")
    calls = []

    def later(*a):
        """Whole while duplicates are looked for, short when it is read again to be written."""
        calls.append(1)
        return whole(*a)

    monkeypatch.setattr(compaction, "records", later)
    places = compaction.first_places
    monkeypatch.setattr(compaction, "first_places", lambda rows: places(rows).withColumn("line_no", compaction.F.when(compaction.F.col("file_id") == 9, 5).otherwise(compaction.F.col("line_no"))))
    with pytest.raises(RuntimeError, match="written"):
        compact(files, path=f"file://{tmp_path}/out")
    assert calls and not (tmp_path / "out").exists()


def test_a_file_that_changes_after_the_freeze_is_noticed(spark, monkeypatch, tmp_path):
    import pandas as pd

    path = tmp_path / "files.parquet"
    frame = pd.DataFrame({"file_id": [1, 2], "body": ["a\nb", "c"]})
    frame.to_parquet(path)
    files = spark.read.parquet(f"file://{path}")
    real = compaction.pack

    def change(*a):
        frame.assign(body=["a\nB", "c"]).to_parquet(path)
        return real(*a)

    monkeypatch.setattr(compaction, "pack", change)
    with pytest.raises(RuntimeError, match="manifest"):
        compact(files, path=f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists()
