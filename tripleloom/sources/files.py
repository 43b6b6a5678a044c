"""Other files of a store: N-Triples as statements, encoded triples, result sinks, graph exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.operators.wide import ordinals
from tripleloom.runtime import stored
from tripleloom.sources.ntriples import globbed, has_ending, read_ntriples, reason, to_ntriples
from tripleloom.store import TripleStore


def statements(parsed: DataFrame) -> DataFrame:
    """Structs s, p, o of parsed N-Triples rows; rows that aren't well formed are left out."""
    blank = F.lit(None).cast("string")
    node = lambda kind, lex, lang=blank, dt=blank: F.struct(kind.alias("kind"), lex.alias("lex"), lang.alias("lang"), dt.alias("dt"))
    c = F.col
    return parsed.where("well_formed").select(node(c("s_kind"), c("s_lex")).alias("s"), node(F.lit("I"), c("p_lex")).alias("p"), node(c("o_kind"), c("o_lex"), c("o_lang"), c("o_dt")).alias("o"))


def load(spark: SparkSession, path: str, identity: str = "rdf") -> TripleStore:
    """A store from a file or a folder of N-Triples (.nt) and Turtle (.n3, .ttl), compressed or not. What can't be read is left
    out of the facts and is in the store's ``skipped``: file_name, stmt (a line, or a piece with the fault) and reason."""
    own = has_ending(path, "nt", "n3", "ttl")  # of such a folder, every file is meant
    lines = read_ntriples(spark, path, "" if own else globbed("nt"))
    bad_lines = lines.where("NOT well_formed").select("file_name", "stmt", reason(F.col("stmt"), F.col("o_lex"), F.col("o_dt"), F.col("well_formed")).alias("reason"))
    from tripleloom.sources.turtle import read_turtle

    pieces = read_turtle(spark, path, "" if own else globbed("n3", "ttl")) if not has_ending(path, "nt") else None
    if pieces is None:
        return _loaded(statements(lines), bad_lines, identity)
    bad_pieces = pieces.where("corrupt IS NOT NULL").select("file_name", F.col("corrupt").alias("stmt"), F.lit("not Turtle").alias("reason"))
    turtle = pieces.where("corrupt IS NULL").select("s", "p", "o")
    if own:
        return _loaded(turtle, bad_pieces, identity)
    return _loaded(statements(lines).unionByName(turtle), bad_lines.unionByName(bad_pieces), identity)


def _loaded(facts: DataFrame, skipped: DataFrame, identity: str) -> TripleStore:
    store = TripleStore.from_terms(facts, identity)
    store.skipped = skipped
    return store


def read_encoded(spark: SparkSession, path: str, separator: str = " ") -> DataFrame:
    """s, p, o from a file of three numbers in a line; lines that aren't so are left out."""
    rows = spark.read.schema("s long, p long, o long").option("mode", "DROPMALFORMED").csv(path, sep=separator)
    return rows.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def write_ntriples(store: TripleStore, path: str) -> None:
    """The facts as N-Triples text files."""
    ntriples_lines(store).write.mode("overwrite").text(path)


def ntriples_lines(store: TripleStore) -> DataFrame:
    """The facts as N-Triples lines (column value)."""
    term = store.terms.select("id", to_ntriples(F.col("kind"), F.col("lex"), F.col("lang"), F.col("dt")).alias("text"))
    df = store.triples.select("s", "p", "o")
    for c in "spo":
        df = df.join(term.toDF(c, f"{c}_text"), c)
    return df.select(F.concat_ws(" ", "s_text", "p_text", "o_text", F.lit(".")).alias("value"))


def write_result(result: DataFrame, path: str) -> None:
    """Solutions as text, a row in a line, values separated by a pipe, without a header; unbound values are empty."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in result.columns]
    result.select(F.concat_ws("|", *columns).alias("value")).write.mode("overwrite").text(path)


# graph exports


def graph_edges(store: TripleStore) -> DataFrame:
    """a, b with a < b: the undirected edges between different terms, whatever the predicate; plain literals aren't vertices,
    typed and tagged ones are."""
    plain = store.terms.where("kind = 'L' AND coalesce(lang, '') = '' AND coalesce(dt, '') = ''").select(F.col("id").alias("o"))
    links = store.triples.where("s <> o").select("s", "o").join(plain, "o", "left_anti")
    return links.select(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).distinct()


def numbered_graph(store: TripleStore) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, vertex from 1, in id order) and edges (a, b as vertices, a < b)."""
    edges = stored(graph_edges(store), "edges")
    vertices = ordinals(edges.select(F.explode(F.array("a", "b")).alias("id")), "id").select("id", (F.col("ordinal") + 1).alias("vertex"))
    left, right = vertices.toDF("a", "va"), vertices.toDF("b", "vb")
    return vertices, edges.join(left, "a").join(right, "b").select(F.col("va").alias("a"), F.col("vb").alias("b"))


def adjacency(edges: DataFrame) -> DataFrame:
    """vertex, neighbours: the sorted neighbours of each vertex."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("vertex", "other")
    return both.groupBy("vertex").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def export_graph(store: TripleStore, path: str) -> None:
    """Input of external graph partitioners, as folders of text files: <path>.mf (header with the numbers of vertices and
    edges, then the neighbours of vertex 1, 2, …), <path>.idf (directed edge list), <path>.dict (texts in vertex order)."""
    vertices, edges = numbered_graph(store)
    vertices, edges = stored(vertices, "vertices"), stored(edges, "edges")
    head = store.spark.createDataFrame([(0, f"{vertices.count()} {edges.count()}")], "vertex long, value string")
    lines = adjacency(edges).select("vertex", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("value"))
    head.unionByName(lines).orderBy("vertex").select("value").write.mode("overwrite").text(f"{path}.mf")
    s, o = vertices.toDF("s", "vs"), vertices.toDF("o", "vo")
    directed = store.triples.where("s <> o").select("s", "o").join(s, "s").join(o, "o")
    directed.select(F.concat_ws(" ", "vs", "vo").alias("value")).write.mode("overwrite").text(f"{path}.idf")
    vertices.join(store.terms, "id").orderBy("vertex").select(F.regexp_replace("lex", "[\r\n]+", " ").alias("value")).write.mode("overwrite").text(f"{path}.dict")
