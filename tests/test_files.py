import pytest

from tripleloom.plans.engine import Engine
from tripleloom.plans.stats import analyse
from tripleloom.plans.summary import file_parts
from tripleloom.sources.files import adjacency, export_graph, graph_edges, load, ntriples_lines, read_encoded, write_ntriples, write_result
from tripleloom.store import TripleStore
from tripleloom.streaming.ingest import ingest, stream_lines

FACTS = """<h:a> <h:p> <h:b> .
<h:b> <h:p> <h:a> .
<h:b> <h:q> <h:c> .
<h:c> <h:p> <h:c> .
<h:a> <h:n> "plain \\"x\\"" .
<h:a> <h:n> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .
<h:a> <h:n> "five"@en .
broken line
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("facts")
    (d / "a.nt").write_text(FACTS)
    (d / "b.n3").write_text("@prefix h: <h:> .\n<h:a> <h:p> <h:b> ; <h:q> h:d .\n")
    return d


def names(spark, path):
    return sorted(r[0] for r in spark.read.text(path).collect())


def test_load_folder_and_files(spark, folder):
    assert load(spark, f"file://{folder}").triples.count() == 8
    assert load(spark, f"file://{folder}/a.nt").triples.count() == 7
    assert load(spark, f"file://{folder}/b.n3").triples.count() == 2
    assert load(spark, f"file://{folder}", identity="lexical").triples.count() == 8


def test_ntriples_are_written_as_they_were_read(spark, folder, tmp_path):
    store = load(spark, f"file://{folder}/a.nt").frozen()
    assert sorted(r[0] for r in ntriples_lines(store).collect()) == sorted(FACTS.strip().split("\n")[:-1])
    write_ntriples(store, f"file://{tmp_path}/out.nt")
    assert load(spark, f"file://{tmp_path}/out.nt").triples.exceptAll(store.triples).count() == 0


def test_result_sink(spark, folder, tmp_path):
    store = load(spark, f"file://{folder}/a.nt")
    df = Engine(store).query("SELECT ?s ?m WHERE { ?s <h:q> ?o OPTIONAL { ?o <h:n> ?m } }")
    write_result(df, f"file://{tmp_path}/r")
    assert names(spark, f"file://{tmp_path}/r") == ["h:b|"]


def test_save_and_load(spark, folder, tmp_path):
    store = analyse(load(spark, f"file://{folder}").frozen())
    saved = store.save(f"file://{tmp_path}/store", buckets=2)
    assert saved.by_object.count() == 8 and saved.predicate_stats.count() == 3 and saved.summary is None
    for q in ("SELECT ?s WHERE { ?s <h:p> <h:b> }", "SELECT ?o WHERE { <h:a> <h:n> ?o }"):
        assert sorted(map(tuple, Engine(saved).query(q).collect())) == sorted(map(tuple, Engine(store).query(q).collect()))


def test_graph_export(spark, folder, tmp_path):
    store = load(spark, f"file://{folder}/a.nt").frozen()
    assert graph_edges(store).count() == 4  # a-b, b-c, a-5, a-five; no loops, no plain literals
    export_graph(store, f"file://{tmp_path}/g")
    lines = [r[0] for r in spark.read.text(f"file://{tmp_path}/g.mf").collect()]
    assert len(lines) == 6 and "5 4" in lines
    neighbours = [list(map(int, x.split())) for x in lines if x != "5 4"]
    assert sum(map(len, neighbours)) == 8
    assert len(names(spark, f"file://{tmp_path}/g.idf")) == 5 and sorted(names(spark, f"file://{tmp_path}/g.dict")) == ["5", "five", "h:a", "h:b", "h:c"]
    assert adjacency(graph_edges(store).where("false")).count() == 0


def test_partition_file(spark, folder, tmp_path):
    store = load(spark, f"file://{folder}/a.nt").frozen()
    (tmp_path / "parts").write_text("100\n101\nx\n102\n")
    (tmp_path / "terms").write_text("h:a\nh:b\nh:c\nnobody\n")
    got = file_parts(store, f"file://{tmp_path}/parts", f"file://{tmp_path}/terms")
    assert sorted(r["part"] for r in got.collect()) == [100, 101]
    parted = store.with_parts(got)
    assert parted.triples.where("s_part = 100").count() == 4


def test_encoded_triples(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 2 3\n4 5 6\nnope\n7 8\n")
    assert sorted(tuple(r) for r in read_encoded(spark, f"file://{tmp_path}/t.txt").collect()) == [(1, 2, 3), (4, 5, 6)]


def test_store_from_encoded(spark):
    t = spark.createDataFrame([(1, 2, 3), (1, 2, 3), (None, 2, 3), (1, 2, 9)], "s long, p long, o long")
    d = spark.createDataFrame([(1, "I", "h:s", None, None), (2, "I", "h:p", None, None), (3, "L", "x", "EN", None)], "id long, kind string, lex string, lang string, dt string")
    store = TripleStore.from_encoded(t, d)
    assert store.triples.count() == 2
    e = Engine(store)
    assert sorted((r[0] or "") for r in e.query("SELECT ?o WHERE { <h:s> <h:p> ?o }").collect()) == ["", "x"]
    assert e.query("SELECT ?s WHERE { ?s <h:p> 'x'@en }").count() == 1
    assert e.query("SELECT ?s WHERE { ?s <h:none> ?o }").count() == 0


def test_streaming_ingest(spark, folder, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.nt").write_text(FACTS)
    run = lambda: ingest(stream_lines(spark, f"file://{source}"), f"file://{tmp_path}/t", f"file://{tmp_path}/f", f"file://{tmp_path}/c", once=True).awaitTermination()
    run()
    (source / "2.nt").write_text("<h:x> <h:p> <h:y> .\n# no statement\n<h:x> .\n")
    run()
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 8
    assert spark.read.parquet(f"file://{tmp_path}/f").count() == 2


def test_compressed_files_and_what_is_skipped(spark, tmp_path):
    import bz2
    import gzip

    (tmp_path / "a.nt.gz").write_bytes(gzip.compress(FACTS.encode()))
    (tmp_path / "b.nt.bz2").write_bytes(bz2.compress(b"<h:z> <h:p> <h:z> .\nbroken again\n"))
    (tmp_path / "c.ttl.gz").write_bytes(gzip.compress(b"@prefix h: <h:> .\nh:y h:p h:y .\nh:y nope:p h:y .\n"))
    store = load(spark, f"file://{tmp_path}")
    assert store.triples.count() == 9
    rows = sorted((r["file_name"].rsplit("/", 1)[1], r["reason"]) for r in store.skipped.collect())
    assert [r[0] for r in rows] == ["a.nt.gz", "b.nt.bz2", "c.ttl.gz"] and all(r[1] for r in rows)
    assert load(spark, f"file://{tmp_path}/a.nt.gz").skipped.count() == 1


def test_lines_are_numbered_over_splits(spark, tmp_path, monkeypatch):
    n = 20_000
    (tmp_path / "terms.txt").write_text("\n".join(f"h:{i}" for i in range(n)) + "\n")
    (tmp_path / "parts.txt").write_text("\n".join(str(i % 7) if i % 5 else "" for i in range(n)) + "\n")
    store = TripleStore.from_terms(spark.range(n).selectExpr("struct('I' kind, concat('h:', id) lex, '' lang, '' dt) s", "struct('I' kind, 'h:p' lex, '' lang, '' dt) p", "struct('L' kind, 'x' lex, '' lang, '' dt) o")).frozen()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        parts = file_parts(store, f"file://{tmp_path}/parts.txt", f"file://{tmp_path}/terms.txt")
        got = {r["lex"]: r["part"] for r in parts.join(store.terms, "id").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"h:{i}": i % 7 for i in range(n) if i % 5}


def test_large_turtle_files_are_refused(spark, tmp_path, monkeypatch):
    from tripleloom.sources import turtle

    (tmp_path / "a.ttl").write_text("<h:a> <h:b> <h:c> .")
    monkeypatch.setattr(turtle, "MAX_BYTES", 5)
    with pytest.raises(ValueError, match="a.ttl"):
        turtle.read_turtle(spark, f"file://{tmp_path}")


def test_saved_layouts_join_without_exchange(spark, tmp_path):
    store = TripleStore.from_terms(spark.range(3000).selectExpr("struct('I' kind, concat('h:', id) lex, '' lang, '' dt) s", "struct('I' kind, concat('h:p', id % 2) lex, '' lang, '' dt) p", "struct('I' kind, concat('h:', id % 40) lex, '' lang, '' dt) o")).frozen()
    saved = analyse(store).save(f"file://{tmp_path}/store", buckets=4)
    again = TripleStore.load(spark, f"file://{tmp_path}/store")
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for s in (saved, again):
            df = Engine(s).query("SELECT ?a ?b ?c WHERE { ?a <h:p0> ?b . ?a <h:p1> ?c }", "ids")
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_keys_are_in_ranges(spark, tmp_path):
    store = TripleStore.from_terms(spark.range(2000).selectExpr("struct('I' kind, if(id % 3 = 0, 'h:hot', concat('h:', id)) lex, '' lang, '' dt) s", "struct('I' kind, 'h:p' lex, '' lang, '' dt) p", "struct('I' kind, concat('h:', id) lex, '' lang, '' dt) o")).frozen()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store.save(f"file://{tmp_path}/store", buckets=16)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    about = spark.read.parquet(f"file://{tmp_path}/store/about").first()
    assert (about["by_subject"], about["by_object"], about["terms"]) == (0, 16, 16)
    assert len(spark.read.parquet(f"file://{tmp_path}/store/by_subject").where(f"s = {store.triples.groupBy('s').count().orderBy('count', ascending=False).first()[0]}").selectExpr("_metadata.file_path").distinct().collect()) > 1
