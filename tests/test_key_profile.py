import random
from collections import Counter

import pytest

from tripleloom.operators.key_profile import hot_keys, key_profile


def brute(rows, at):
    out = {}
    for key in {r[at] for r in rows}:
        values = [r[2] for r in rows if r[at] == key]
        real = sorted(v for v in values if v is not None)
        c = Counter(real)
        best = min(c.items(), key=lambda x: (-x[1], x[0])) if c else (None, None)
        p = lambda q: real[max(1, -(-int(q * 100 * len(real)) // 100)) - 1] if real else None
        out[key] = (len(values), len(c), *best, p(0.25), p(0.5), p(0.75))
    return out


def profile(df):
    return {(r["role"], r["key"]): tuple(r)[2:] for r in key_profile(df, {"s": "s", "p": "p"}, "o").collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 1, rng.randrange(20), None]), rng.choice([7, 7, rng.randrange(5)]), rng.choice([None, 3, rng.randrange(30)])) for _ in range(600)]
    got = profile(spark.createDataFrame(rows, "s long, p long, o long"))
    want = {(r, k): v for r, at in (("s", 0), ("p", 1)) for k, v in brute(rows, at).items()}
    assert got == want


def test_ties_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 2, 5), (1, 2, 4), (1, 2, 4), (1, 2, 5)], "s long, p long, o long").selectExpr("*", "'x' AS role", "'y' AS key", "1 AS weight", "0 AS value")
    got = profile(df)
    assert got["s", 1] == (4, 2, 4, 2, 4, 4, 5)
    assert got["p", 2] == got["s", 1]


def test_empty_and_all_null(spark):
    assert profile(spark.createDataFrame([], "s long, p long, o long")) == {}
    got = profile(spark.createDataFrame([(None, None, None), (None, None, None)], "s long, p long, o long"))
    assert got == {("s", None): (2, 0, None, None, None, None, None), ("p", None): (2, 0, None, None, None, None, None)}


def test_hot_keys_counts_every_row(spark):
    rows = [(1, i, None) for i in range(50)] + [(None, 3, 4)] * 49 + [(2, 3, 4)]
    got = {(r["role"], r["key"], r["n_rows"]) for r in hot_keys(spark.createDataFrame(rows, "s long, p long, o long"), {"s": "s", "p": "p"}, "o", 0.5).collect()}
    assert got == {("s", 1, 50), ("p", 3, 51)}
    assert hot_keys(spark.createDataFrame([], "s long, p long, o long"), {"s": "s"}, "o", 0.02).count() == 0
