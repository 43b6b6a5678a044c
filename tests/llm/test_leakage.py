import random

import numpy as np
import pytest

from tripleloom.llm import leakage, tex
from tripleloom.llm.leakage import diagonals, fingerprints, leaks, passing, readings, tiles, word_ids


def compare(text, items, seed):
    """item -> longest tile and covered words, the best of the readings; the steps of leaks() without Spark."""
    best = {}
    for item, body in items:
        at = {}
        for i, f in enumerate(fingerprints(word_ids(tex.words(tex.plain(body, {}))), seed).tolist()):
            at.setdefault(f, []).append(i)
        for words in readings(text):
            pairs = [(p, i) for p, f in enumerate(fingerprints(word_ids(words), seed).tolist()) for i in at.get(f, ())]
            if pairs and (got := tiles(diagonals(*np.array(pairs).T, seed), seed)):
                old = best.get(item, (0, 0))
                best[item] = (max(old[0], *(n for n, _, _ in got)), max(old[1], sum(n for n, _, _ in got)))
    return best

WORDS = [f"w{i}" for i in range(40)]


def longest_common_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


@pytest.mark.parametrize("seed", range(5))
def test_longest_tile_is_the_longest_common_run(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS[:12]) for _ in range(30))) for i in range(12)]
    for _ in range(20):
        words = [rng.choice(WORDS) for _ in range(40)]
        i, text = rng.choice(items)
        part = text.split()
        k = rng.randrange(20)
        words[10:10] = part[k : k + rng.randrange(2, 12)]
        got = {i: n for i, (n, _) in compare(" ".join(words), items, 3).items()}
        want = {i: n for i, t in items if (n := longest_common_run(words, t.split())) >= 3}
        assert got == want


def test_tiles_do_not_overlap_and_cover_reordered_passages():
    assert compare("g h i j k l x a b c d e f", [(1, "a b c d e f g h i j k l")], 3) == {1: (6, 12)}
    got = tiles([(6, 0, 0), (5, 4, 4), (3, 20, 0)], 3)
    assert got == [(6, 0, 0), (3, 6, 6)]


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS longest")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")
    return sorted((r["doc_id"], r["item_id"], r["longest"]) for r in leaks(d, i).collect())


ITEM = "On Thursday the falconer from Toôgla counts 777 rope coils but finds only 571 cracked ones there."
W = ITEM.split()


def test_readings(spark):
    docs = [
        (1, "x " + ITEM + " y"),
        (2, "\\emph{On} Thursday~the {falconer} fr\\-om To\\^{o}gla % note\ncounts $777$ rope\\ coils but \\textbf{finds} only"),
        (3, "seen\n% " + " ".join(W[:8]) + "\n%% " + " ".join(W[8:]) + "\nseen"),
        (4, " ".join(W[:5]) + " other " + " ".join(W[6:11])),
        (5, None), (6, ""), (7, "% only\n"), (8, " ".join(W[:6]) + "\n% " + " ".join(W[6:])),
        (9, "\\iffalse " + ITEM.upper() + " \\fi"),
        (9, "\\iffalse " + ITEM.upper() + " \\fi"),
        (None, ITEM),
    ]
    items = spark.createDataFrame([(5, ITEM), (6, None), (7, ""), (8, "short item")], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["longest"]) for r in leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()]
    assert sorted(got, key=str) == sorted([(1, 5, 17), (2, 5, 13), (3, 5, 17), (8, 5, 17), (9, 5, 17), (None, 5, 17)], key=str)


def test_empty_tables_and_long_documents(spark):
    assert found(spark, [], [(1, ITEM)]) == []
    assert found(spark, [(1, ITEM)], []) == []
    long = "filler words here " * 200_000 + ITEM + " more" * 1000
    assert found(spark, [(1, long)], [(5, ITEM)]) == [(1, 5, 17)]
    assert found(spark, [(1, (ITEM + " ") * 3000)], [(5, ITEM)])[0][2] == 17


def test_many_items(spark):
    """100,000 items, a small filter, seeds that all items share: nothing is lost, and no more is found than brute force finds."""
    n = 100_000
    items = [(i, f"we show that the following holds for item q{i} " + " ".join(f"q{i}x{j}" for j in range(13))) for i in range(n)]
    docs = [(i, f"intro {items[i][1] if i == 2003 else ' '.join(items[i][1].split()[9:])} end") for i in range(0, n, 2003)] + [(n, "nothing of it is here at all")]
    got = found(spark, docs, items)
    own = [(d, i, k) for d, i, k in got if k >= 12]
    assert own == sorted((i, i, 22 if i == 2003 else 13) for i, _ in docs[:-1])
    assert len(got) - len(own) == n - 1  # those that share the sentence that all items begin with


def test_the_filter_lets_every_seed_through(spark, monkeypatch):
    monkeypatch.setattr(leakage, "FILTER_BITS", (20, 20))
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(2000)], "item_id long, text string")
    seeds = leakage.item_seeds(items, "item_id", "text", 6)
    bits = leakage.seed_filter(seeds)
    prints = np.array([r[0] for r in seeds.select("fingerprint").collect()]).view(np.uint64)
    assert len(prints) == 2000 * 25 and len(passing(prints, bits)) == len(prints)
    others = np.random.default_rng(1).integers(0, 2**64, 100_000, dtype=np.uint64)
    assert len(passing(others, bits)) < 6_000


def test_items_are_read_like_documents():
    assert (word_ids(tex.words(tex.plain("St\u00e9an\u0301 A-B 5", {}))) == word_ids(tex.words("stéań a b 5"))).all()


def test_passages_cut_by_comments_into_short_runs():
    pieces = [" ".join(W[i : i + 4]) for i in (0, 4, 8)]
    assert compare("seen\n{}\n% {}\n{}\nseen".format(*pieces), [(5, ITEM)], 6) == {5: (12, 12)}
    assert compare("seen {}\n\\iffalse {} \\fi\n{} seen".format(*pieces), [(5, ITEM)], 6) == {5: (12, 12)}


def test_items_that_share_an_id_are_all_searched(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(n)) for x, n in (("a", 13), ("b", 14), ("c", 15)))
    items = [(1, a), (1, b), (1, b), (None, c), (None, a)]
    got = leaks(spark.createDataFrame([(7, a), (8, b), (9, c)], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = [(r["doc_id"], r["item_id"], r["longest"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(7, 1, 13), (7, None, 13), (8, 1, 14), (9, None, 15)], key=str)
