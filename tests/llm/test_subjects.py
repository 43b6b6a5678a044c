import random

import numpy as np
import pytest

from tripleloom.llm.subjects import Lookup, Settings, choose_features, leaf_report, subjects, terms_of, tokenised

AREAS = ["biology", "law", "sport"]
NOUNS = {"biology": ["larva", "gene", "habitat", "enzyme", "plasmid", "seedling"], "law": ["tribunal", "statute", "plaintiff", "deed", "appeal", "clause"], "sport": ["sprint", "coach", "referee", "midfield", "marathon", "goalkeeper"]}
SETTINGS = Settings(leaves=8, least_z=3.0)


def corpus(n, seed=0):
    rng = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        mine = rng.sample(AREAS, rng.choice([1, 1, 2]))
        text = []
        for _ in range(24):
            if rng.random() < 0.4:
                text.append(f"This {rng.choice(['setting', 'trend', 'limit'])} needs no further comment.")
            else:
                a = rng.choice(NOUNS[rng.choice(mine)])
                text.append(f"The interplay between {a} and number {rng.randrange(50)} has been studied.")
        docs.append((i, " ".join(text), mine[0][:4] if rng.random() < 0.7 else None, 0))
        truth[i] = set(mine)
    return docs, truth


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, shelf_code string, x int").withColumnsRenamed({"x": "area"}).selectExpr("*", "1 AS words", "2 AS share", "3 AS leaf")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, area string, rater string")


@pytest.fixture(scope="module")
def result(spark):
    docs, truth = corpus(240)
    labels = [(i, a.upper() + " ", "r") for i in range(0, 60) for a in truth[i]] + [(61, None, "r"), (62, "cooking", "r"), (None, "law", "r")]
    docs += [(1000, None, "law", 0), (1001, "", None, 0), (1002, "Nothing of note. \\title{larva}", "biol", 0), (1003, "The larva waits. " * 3000, None, 0)]
    return subjects(frame(spark, docs), labels_of(spark, labels), AREAS, settings=SETTINGS), truth


def test_held_out_accuracy(result):
    got = {}
    for r in result[0].shares.where("share >= 0.25").collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
    held = [i for i in range(60, 240)]
    right = sum(got.get(i) == result[1][i] for i in held)
    assert right / len(held) > 0.9
    assert not {1000, 1001, 1002} & set(got) and got[1003] == {"biology"}


def test_leaves_have_words(result):
    rows = leaf_report(result[0]).collect()
    assert {r["area"] for r in rows} == set(AREAS)
    assert any("larva" in r["terms"] for r in rows if r["area"] == "biology" and r["weight"] > 0.5)


def test_nothing_to_learn_from(spark):
    docs, _ = corpus(30)
    bare = [(i, t, None, 0) for i, t, _, _ in docs]
    assert subjects(frame(spark, bare), labels_of(spark, []), AREAS, settings=SETTINGS).shares.count() == 0
    none = subjects(frame(spark, []), labels_of(spark, [(1, "law", "r")]), AREAS, settings=SETTINGS)
    assert none.shares.count() == 0 and leaf_report(none).count() == 0


def test_repeated_documents_are_documents_of_their_own(spark):
    docs, truth = corpus(120, 4)
    got = subjects(frame(spark, docs + docs[:5]), labels_of(spark, [(i, a, "r") for i in range(60) for a in truth[i]] * 2), AREAS, settings=SETTINGS).shares
    n = {r["doc_id"]: r["n"] for r in got.where("share >= 0.25").groupBy("doc_id", "area").count().withColumnRenamed("count", "n").collect()}
    assert all(n[i] == 2 for i in range(5)) and n[7] == 1


def test_terms_keep_to_their_sentences(spark):
    df = spark.createDataFrame([(1, "A b. C.", None), (2, "", None), (3, "d e f", None)], "doc_id long, text string, g string")
    batch = tokenised(df, "doc_id", "text", "g").coalesce(1).orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    term, row, sent, row_of, n = terms_of(batch)
    assert n == 3 and row_of.tolist() == [0, 0, 2]
    assert sorted(zip(row.tolist(), sent.tolist())) == [(0, 0), (0, 0), (0, 0), (0, 1), (2, 2), (2, 2), (2, 2), (2, 2), (2, 2)]


def test_lookup():
    rng = np.random.default_rng(0)
    known = np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64))
    asked = np.concatenate([known[::3], rng.integers(0, 2**64, 400, dtype=np.uint64)])
    rng.shuffle(known)
    at, place = Lookup(known)(asked)
    assert (known[place] == asked[at]).all() and len(at) == np.isin(asked, known).sum()
    assert len(Lookup(known[:0])(asked)[0]) == 0


def test_terms_of_less_than_a_thousandth_of_the_documents_count(spark):
    statistics = spark.createDataFrame([(1, 15, 15, 15, 0), (2, 9, 9, 9, 0), (3, 15, 15, 1, 14)], "term long, df long, labelled long, n0 long, n1 long")
    got = choose_features(statistics, 20_000, 20_000, np.array([2_000, 18_000]), Settings())
    assert got.terms.tolist() == [1]
