import numpy as np
import pytest

from tripleloom.llm import queries, set_sketch
from tripleloom.llm.set_sketch import Scale, cardinality, distinct_sketches, draws, estimated, fill, group_codes, joint, levels, merged, overlaps, registers_of

RNG = np.random.default_rng(5)


def hashes(n):
    return RNG.integers(0, 2**64, n, dtype=np.uint64)


def sketch(h, scale):
    out = np.zeros((1, scale.m), np.uint8)
    fill(out, np.zeros(len(h), dtype=np.int64), h, scale)
    return out[0]


@pytest.mark.parametrize("base", [1.14, 1.5, 2.0])
@pytest.mark.parametrize("n", [100, 3_000, 60_000])
def test_error_is_within_the_stated_bound(base, n):
    scale = Scale(m=256, b=base)
    errors = [cardinality(sketch(hashes(n), scale)[None, :], scale)[0] / n - 1 for _ in range(12)]
    assert np.sqrt(np.mean(np.square(errors))) < 1.8 * scale.rsd


def test_merge_is_maximum():
    scale = Scale()
    a, b = hashes(3000), hashes(2000)
    assert (np.maximum(sketch(a, scale), sketch(b, scale)) == sketch(np.concatenate([b, a, a]), scale)).all()


def test_left_out_draws_change_nothing():
    scale = Scale()
    for n in (1, 17, 200, 5000):
        h = hashes(n)
        got = np.zeros((2, scale.m), np.uint8)
        fill(got, np.repeat([0, 1], n), np.concatenate([h, h[::-1]]), scale)
        want = np.zeros(scale.m, np.uint8)
        for at, register, x in draws(h, np.full(n, scale.b), scale):
            np.maximum.at(want, register, scale.level(x))
        assert (got == want).all()
        twice = got.copy()
        fill(twice, np.zeros(n, dtype=np.int64), h, scale)
        assert (twice == got).all()


def test_joint_estimates():
    scale = Scale(m=1024)
    off = {c: [] for c in ("jaccard", "n_union", "n_both")}
    for _ in range(30):
        a, b, c = hashes(600), hashes(300), hashes(900)
        x, y = (sketch(np.concatenate(h), scale)[None, :] for h in ((a, b), (b, c)))
        got = joint(x, y, cardinality(x, scale), cardinality(y, scale), scale)
        for name, error, true in (("jaccard", "jaccard_error", 300 / 1800), ("n_union", "union_error", 1800), ("n_both", "both_error", 300)):
            off[name].append((got[name][0] - true) / got[error][0])
    for z in off.values():
        assert np.mean(np.abs(z) < 1.96) >= 0.8 and np.sqrt(np.mean(np.square(z))) < 1.4
    same = joint(x, x, cardinality(x, scale), cardinality(x, scale), scale)
    assert same["jaccard"][0] > 0.97


def test_codes_beyond_64_bits_lose_no_group():
    n = 1 << 16
    rng = np.random.default_rng(3)
    codes = [np.concatenate([rng.permutation(n), rng.integers(0, n, 1000)]) for _ in range(5)]
    first, group = group_codes([(c, n) for c in codes], n + 1000)
    assert len(first) == len(set(zip(*codes))) and all((c[first][group] == c).all() for c in codes)


def exact(rows, dims):
    out = {}
    for combo in levels(dims):
        for r in rows:
            if r["s"] is not None:
                key = ("+".join(combo), r["day"], *(r[d] if d in combo else None for d in dims))
                out.setdefault(key, set()).add(r["s"])
    return {k: len(v) for k, v in out.items()}


def random_rows(n):
    rng = np.random.default_rng(1)
    pick = lambda top, nulls=True: None if nulls and rng.random() < 0.05 else int(rng.integers(top))
    return [{"s": pick(5000) if rng.random() < 0.7 else pick(3), "day": pick(3), "p": pick(4), "feed": None if rng.random() < 0.1 else f"f{rng.integers(2)}"} for _ in range(n)]


@pytest.mark.parametrize("task_rows", [2_000_000, 900])
def test_groups_and_hot_leads(spark, task_rows):
    rows = random_rows(4000)
    df = spark.createDataFrame([(r["s"], r["day"], r["p"], r["feed"]) for r in rows], "s long, day int, p int, feed string").selectExpr("*", "1 AS lead", "2 AS h", "3 AS n", "'x' AS hashes")
    scale = Scale(m=512, sparse=64)
    got = {tuple(r)[:4]: (r["n_distinct"], r["low"], r["high"]) for r in estimated(distinct_sketches(df, "s", "day", ["p", "feed"], scale, task_rows=task_rows), scale).collect()}
    want = exact(rows, ["p", "feed"])
    assert set(got) == set(want)
    for k, n in want.items():
        if n <= scale.sparse:
            assert got[k] == (n, n, n)
        else:
            assert abs(got[k][0] / n - 1) < 5 * scale.rsd and got[k][1] < got[k][0] < got[k][2]


def test_hot_days_are_split_and_merged(spark, monkeypatch):
    seen = []
    real = set_sketch.merged
    monkeypatch.setattr(set_sketch, "merged", lambda parts, *a: seen.append(parts.count()) or real(parts, *a))
    df = spark.createDataFrame([(i, 0 if i % 3 else i % 400, 1) for i in range(9000)], "s long, day int, p int")
    got = {(r["dimensions"], r["day"]): r["n_distinct"] for r in estimated(distinct_sketches(df, "s", "day", ["p"])).collect()}
    assert seen[0] >= 2 * 9000 * 2 // 3 // (9000 // 64 + 1)  # as many parts as the hot day has, for each combination
    assert abs(got["", 0] / len([i for i in range(9000) if i % 3 or i % 400 == 0]) - 1) < 5 * Scale().rsd


def test_partial_results_of_days_merge(spark):
    rows = random_rows(3000)
    df = spark.createDataFrame([(r["s"], r["day"], r["p"], r["feed"]) for r in rows], "s long, day int, p int, feed string")
    scale = Scale()
    whole = merged(distinct_sketches(df, "s", "day", ["p", "feed"], scale), ["dimensions", "p", "feed"], scale)
    got = {tuple(r)[:3]: r["n_distinct"] for r in estimated(whole, scale).collect()}
    sets = {}
    for combo in levels(["p", "feed"]):
        for r in rows:
            if r["s"] is not None:
                sets.setdefault(("+".join(combo), r["p"] if "p" in combo else None, r["feed"] if "feed" in combo else None), set()).add(r["s"])
    assert set(got) == set(sets)
    for k, v in sets.items():
        assert got[k] == len(v) if len(v) <= scale.sparse else abs(got[k] / len(v) - 1) < 5 * scale.rsd


def test_empty_ties_and_overlap(spark):
    none = spark.createDataFrame([], "s long, day int, p int")
    assert estimated(distinct_sketches(none, "s", "day", ["p"])).count() == 0
    assert merged(distinct_sketches(none, "s", "day", ["p"]), ["p"]).count() == 0
    only_null = spark.createDataFrame([(None, 1, 1)], "s long, day int, p int")
    assert distinct_sketches(only_null, "s", "day", ["p"]).count() == 0
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, i % 2 if i < 10 else 0, 1) for i in [*range(20), *range(20)]] + [(0, 1, 1)], "s long, day int, p int")
    sk = distinct_sketches(df, "s", "day", ["p"], combos=[("p",)]).select("day", F.struct("hashes", "registers").alias("k"))
    pairs = sk.where("day = 0").select(F.lit(1).alias("x"), F.col("k").alias("a")).join(sk.where("day = 1").select(F.lit(1).alias("x"), F.col("k").alias("b")), "x")
    assert tuple(overlaps(pairs, "a", "b").first()) == (1, 15.0, 6.0, 20.0, 1.0, 0.05, 0.0, 0.0, 0.0)


def test_every_combination_with_and_without_the_day(spark, monkeypatch):
    rows = [r | {"s_part": i % 3 or None} for i, r in enumerate(random_rows(3000))]
    df = spark.createDataFrame([(r["s"], r["day"], r["p"], r["feed"], r["s_part"]) for r in rows], "s long, day int, p int, feed string, s_part int")
    monkeypatch.setattr(queries, "read", lambda *_: df.selectExpr("s", "timestamp_seconds(day * 86400L + 7) AS stated_at", "p", "feed", "s_part"))
    got = queries.p6_distinct(spark, "").selectExpr("dimensions", "datediff(day, DATE '1970-01-01') AS day", "p", "feed", "s_part", "n_distinct").collect()
    names = ["day", "p", "feed", "s_part"]
    sets = {}
    for combo in levels(names):
        for r in rows:
            if r["s"] is not None:
                sets.setdefault(("+".join(combo), *(r[d] if d in combo else None for d in names)), set()).add(r["s"])
    assert len(got) == len(sets) and {tuple(r)[:5] for r in got} == set(sets) and len({k[0] for k in sets}) == 16
    for r in got:
        n = len(sets[tuple(r)[:5]])
        assert r["n_distinct"] == n if n <= queries.SCALE.sparse else abs(r["n_distinct"] / n - 1) < 5 * queries.SCALE.rsd
