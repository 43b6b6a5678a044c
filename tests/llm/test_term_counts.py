import random

import pytest

from tripleloom.llm.term_counts import TermCounts
from tripleloom.runtime import fresh_path


def frame(spark, rows):
    return spark.createDataFrame(rows, "s long, p long, o long").selectExpr("*", "'x' AS role", "'y' AS term", "1 AS record", "2 AS delta", "3 AS _sign")


def brute(rows):
    out = {}
    for role, at in (("p", 1), ("o", 2)):
        for r in rows:
            if r[0] is not None and r[at] is not None:
                n, who = out.setdefault((role, r[at]), [0, set()])
                out[role, r[at]][0] = n + 1
                who.add(r[0])
    return {k: (n, len(who)) for k, (n, who) in out.items()}


def held(c):
    return {(r["role"], r["term"]): (r["occurrences"], r["records"]) for r in c.counts().collect()}


def counts(spark):
    return TermCounts(spark, fresh_path(spark, "terms"), {"p": "p", "o": "o"}, "s", least_buckets=2)


def test_changes_equal_counting_anew(spark):
    rng = random.Random(1)
    row = lambda: (rng.choice([None, *range(8)]), rng.choice([1, 1, 1, 2, None]), rng.choice([5, None, rng.randrange(10)]))
    rows, c = [row() for _ in range(120)], counts(spark)
    c.update(added=frame(spark, rows))
    assert held(c) == brute(rows)
    for _ in range(3):
        gone = rng.sample(range(len(rows)), 25)
        new = [row() for _ in range(20)]
        c.update(added=frame(spark, new), removed=frame(spark, [rows[i] for i in gone]))
        rows = [r for i, r in enumerate(rows) if i not in gone] + new
        assert held(c) == brute(rows)
        assert c.n_records() == len({r[0] for r in rows if r[0] is not None})
    c.merge_runs()
    assert held(c) == brute(rows)
    c.update(removed=frame(spark, rows))
    assert held(c) == {} and c.n_records() == 0


def test_removing_what_is_not_there_fails_and_changes_nothing(spark):
    c = counts(spark)
    c.update(added=frame(spark, [(1, 2, 3)]))
    with pytest.raises(ValueError):
        c.update(removed=frame(spark, [(1, 2, 4)]))
    assert held(c) == {("p", 2): (1, 1), ("o", 3): (1, 1)}


def test_bands_ties_and_empty(spark):
    c = counts(spark)
    assert held(c) == {} and c.n_records() == 0
    c.update(added=frame(spark, []))
    assert held(c) == {} and c.marked(3, 0.08).count() == 0
    c.update()
    c.update(added=frame(spark, [(i, 1, 10 + (i >= 2) + (i >= 5)) for i in range(10)] * 2))
    got = {(r["role"], r["term"]): (r["occurrences"], r["records"], r["band"]) for r in c.marked(3, 0.5).collect()}
    assert got == {("p", 1): (20, 10, "common"), ("o", 10): (4, 2, "rare"), ("o", 11): (6, 3, None), ("o", 12): (10, 5, None)}


def test_state_is_taken_up_by_a_new_object(spark):
    path = fresh_path(spark, "terms")
    make = lambda: TermCounts(spark, path, {"p": "p", "o": "o"}, "s")
    rows = [(i % 7, i % 3, i % 11) for i in range(90)]
    make().update(added=frame(spark, rows))
    assert held(make()) == brute(rows)
    make().update(added=frame(spark, [(1, 2, 3)]), removed=frame(spark, rows[:20]))
    make().update(removed=frame(spark, [(1, 2, 3), *rows[20:40]]))
    last = make()
    assert held(last) == brute(rows[40:]) and last.version == 3 and len(last.runs) == 3
    last.merge_runs()
    assert held(make()) == brute(rows[40:]) and len(make().runs) == 1
    with pytest.raises(ValueError):
        TermCounts(spark, path, {"p": "p"}, "s")


@pytest.mark.parametrize("fails_at", ["pairs", "terms", "records", "commit"])
def test_merge_that_ends_midway_changes_nothing(spark, monkeypatch, fails_at):
    c = counts(spark)
    rows = [(i % 7, i % 3, i % 11) for i in range(60)]
    c.update(added=frame(spark, rows))
    c.update(removed=frame(spark, rows[:10]))
    write, commit = TermCounts._write, TermCounts._commit

    def failing(self, rows, name, *rest):
        if name == fails_at:
            raise OSError(name)
        return write(self, rows, name, *rest)

    def no_commit(self, *a):
        raise OSError("commit")

    monkeypatch.setattr(TermCounts, "_write", failing)
    if fails_at == "commit":
        monkeypatch.setattr(TermCounts, "_commit", no_commit)
    with pytest.raises(OSError):
        c.merge_runs()
    monkeypatch.setattr(TermCounts, "_write", write)
    monkeypatch.setattr(TermCounts, "_commit", commit)
    again = TermCounts(spark, c.path, {"p": "p", "o": "o"}, "s")
    for x in (c, again):
        assert held(x) == brute(rows[10:]) and len(x.runs) == 2
    again.merge_runs()
    assert held(again) == brute(rows[10:]) and len(again.runs) == 1


def test_second_writer_is_refused(spark):
    a = counts(spark)
    b = TermCounts(spark, a.path, {"p": "p", "o": "o"}, "s")
    a.update(added=frame(spark, [(1, 2, 3)]))
    with pytest.raises(FileExistsError):
        b.update(added=frame(spark, [(4, 5, 6)]))
    assert held(TermCounts(spark, a.path, {"p": "p", "o": "o"}, "s")) == brute([(1, 2, 3)])


def test_buckets_follow_from_size_and_are_one_file_each(spark):
    c = TermCounts(spark, fresh_path(spark, "terms"), {"p": "p", "o": "o"}, "s", bucket_rows=100)
    rows = [(i, i % 5, i % 500) for i in range(2_000)]
    c.update(added=frame(spark, rows))
    assert c.buckets == 64
    files = c._state("pairs").inputFiles()
    assert len(files) == len({f.split("bucket=")[1].split("/")[0] for f in files}) == 64
    c.update(removed=frame(spark, rows[100:]))
    c.merge_runs()
    assert c.buckets == 8 and held(c) == brute(rows[:100])
