"""Queries of sources, sinks, syntax and statistics, and the SQL that their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.functions.xsd import RDF, XSD
from tripleloom.plans.algebra import Pattern, Term, Var
from tripleloom.plans.engine import Engine
from tripleloom.plans.stats import estimates, exact_counts
from tripleloom.plans.summary import file_parts, hash_parts, label_parts
from tripleloom.runtime import fresh_path, read, stored
from tripleloom.sources.files import export_graph, load, read_encoded, write_ntriples, write_result
from tripleloom.sources.tables import BASE, VOCABULARY, tables_statements
from tripleloom.sources.turtle import read_turtle
from tripleloom.sparql_catalog import _T, PREFIXES, V, _lex, _p, _pattern, graph, on_graph, prepared, saved
from tripleloom.sparql_catalog import QUERIES as _GRAPH_QUERIES
from tripleloom.sparql_catalog import SQL as _GRAPH_SQL
from tripleloom.sparql_catalog import on_tables
from tripleloom.store import TripleStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _quoted(c: str | Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _iri(path: str, c: str) -> Column:
    return F.concat(F.lit(f"{BASE}{path}/"), F.col(c).cast("string"))


def _node(kind: str, lex: Column, dt: str = "") -> Column:
    return F.struct(F.lit(kind).alias("kind"), lex.alias("lex"), F.lit("").alias("lang"), F.lit(dt).alias("dt"))


def _facts(df: DataFrame, subject: Column, **objects: Column) -> TripleStore:
    """A store of a statement for each row and predicate."""
    each = F.explode(F.array(*(F.struct(_node("I", F.lit(VOCABULARY + p)).alias("p"), o.alias("o")) for p, o in objects.items()))).alias("x")
    return TripleStore.from_terms(df.select(_node("I", subject).alias("s"), each).select("s", "x.p", "x.o"))


# values


@query("SELECT 'http://ex.org/part/' || p_partkey AS p FROM part WHERE CAST('0.00000000000' || p_size AS DECIMAL(38, 20)) > CAST('0.000000000003' AS DECIMAL(38, 20)) AND p_size <> 35")
def filter_precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals that differ only beyond the tenth digit, one of them with more digits than any numeric type."""
    size = _node("L", F.concat(F.lit("0.00000000000"), F.col("p_size").cast("string"), F.lit("0" * 30)), XSD + "decimal")
    store = _facts(read(spark, sf_dir, "part"), _iri("part", "p_partkey"), tiny=size)
    return Engine(store).query(PREFIXES + "SELECT ?p WHERE { ?p e:tiny ?t . FILTER (?t > 0.000000000003 && ?t != 0.0000000000035 && ?t > 0 && ?t + 0 = ?t) }")


@query("SELECT 'http://ex.org/order/' || o_orderkey AS o FROM orders WHERE CAST(o_orderdate AS DATE) + 1 <= DATE '1996-03-01' AND CAST(o_orderdate AS DATE) + 1 > DATE '1996-02-01'")
def filter_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of a day, written as 24:00:00, is the beginning of the next one."""
    end = _node("L", F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T24:00:00")), XSD + "dateTime")
    store = _facts(read(spark, sf_dir, "orders"), _iri("order", "o_orderkey"), until=end)
    return Engine(store).query(PREFIXES + 'SELECT ?o WHERE { ?o e:until ?d . FILTER (?d <= "1996-03-01T00:00:00"^^xsd:dateTime && ?d > "1996-02-01T00:00:00"^^xsd:dateTime) }')


@query("SELECT 'http://ex.org/part/' || p_partkey AS p FROM part WHERE p_size > 25 AND p_size <> 30")
def object_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """true and false as objects of patterns and in filters, and a double in a filter."""
    big = _node("L", (F.col("p_size") > 25).cast("string"), XSD + "boolean")
    round_ = _node("L", (F.col("p_size") == 30).cast("string"), XSD + "boolean")
    store = _facts(read(spark, sf_dir, "part"), _iri("part", "p_partkey"), big=big, round=round_)
    return Engine(store).query(PREFIXES + "SELECT ?p WHERE { ?p e:big true ; e:round ?r . FILTER (?r = false && 1.5e1 > 2) }")


on_tables("object_number", ("part",), "SELECT ?p WHERE { ?p e:size 7 }", "SELECT 'http://ex.org/part/' || p_partkey AS p FROM part WHERE p_size = 7")
on_graph("syntax_where", "PREFIX : <" + V + "> SELECT ?s ?o { # the word WHERE may be left out\n ?s :code ?o # and names have no prefix\n }", f"SELECT d0.lex AS s, d1.lex AS o FROM {_pattern('a', 'code')} {_lex('a.s', 'a.o')}")
on_graph(
    "optional_join",
    "SELECT ?x ?y ?l WHERE { ?x v:cites ?y . OPTIONAL { ?x v:label ?l } OPTIONAL { ?y v:note ?l } }",
    f"SELECT d0.lex AS x, d1.lex AS y, d2.lex AS l FROM {_pattern('a', 'cites')} LEFT JOIN {_pattern('b', 'label')} ON a.s = b.s LEFT JOIN {_pattern('c', 'note')} ON c.s = a.o AND (b.o IS NULL OR b.o = c.o) {_lex('a.s', 'a.o', 'coalesce(b.o, c.o)')}",
)
on_graph(
    "union_unbound_join",
    "SELECT ?s ?x ?l WHERE { { ?s v:cites ?x } UNION { ?s v:note ?l } { ?s v:label ?l } }",
    f"SELECT d0.lex AS s, d1.lex AS x, d2.lex AS l FROM (SELECT a.s, a.o AS x, b.o AS l FROM {_pattern('a', 'cites')} JOIN {_pattern('b', 'label')} ON a.s = b.s UNION ALL SELECT c.s, NULL, c.o FROM {_pattern('c', 'note')} JOIN {_pattern('e', 'label')} ON c.s = e.s AND c.o = e.o) z {_lex('z.s', 'z.x', 'z.l')}",
)


@query(f"SELECT 'scan ?s <{V}code> ?o' AS line")
def explain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the join order in the plan of a query."""
    plan = Engine(saved(spark, sf_dir)).query("EXPLAIN " + PREFIXES + "SELECT ?s ?o WHERE { ?s v:code ?o }")
    return plan.where("plan LIKE 'scan %'").select(F.regexp_replace("plan", " ~.*", "").alias("line"))


# Turtle


def _turtle(spark: SparkSession, rows: DataFrame, head: str) -> TripleStore:
    """Writes statements (column value) as Turtle files, each with the head, and reads them once. A file is parsed by one task, so
    there are several of them however few splits the rows are in."""
    path = fresh_path(spark, "ttl")
    rows.select(F.concat(F.lit(head + "\n"), "value").alias("value")).write.option("maxRecordsPerFile", 10_000).text(path)
    return TripleStore.from_terms(stored(read_turtle(spark, path, "").where("corrupt IS NULL").select("s", "p", "o"), "statements")).frozen()


@query("SELECT 'http://ex.org/customer/' || c_custkey AS c, c_name || chr(9) || 'é \"' || c_mktsegment || '\"' || chr(10) || '# none' AS n, 'x\\y' AS e, c_custkey AS k, TRUE AS b FROM customer")
def turtle_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative IRIs, escapes, long strings, numbers, booleans and comments of Turtle, a statement for each customer."""
    c = F.col
    text = F.concat(F.lit("# a customer\n<customer/"), c("c_custkey"), F.lit('> :n """'), c("c_name"), F.lit('\\t\\u00E9 "'), c("c_mktsegment"), F.lit('"\n# none""" ; :e \'x\\\\y\' , "z"@en ; # more\n :k '), c("c_custkey"), F.lit(" ; :d 1.5 , 2e3 , -7 ; :b true ."))
    store = _turtle(spark, read(spark, sf_dir, "customer").select(text.alias("value")), f"@base <{BASE}> . @prefix : <v#> .")
    found = Engine(store).query(PREFIXES + "SELECT ?c ?n ?e ?k ?b WHERE { ?c e:n ?n ; e:e ?e ; e:k ?k ; e:b ?b ; e:d -7 , 1.5 , 2e3 . FILTER (lang(?e) = '' && datatype(?k) = xsd:integer) }")
    return found.select("c", "n", "e", F.col("k").cast("long").alias("k"), F.col("b").cast("boolean").alias("b"))


@query("SELECT 'http://ex.org/order/' || a.o_orderkey AS o, a.l_linenumber AS first, b.l_linenumber AS second FROM (SELECT l_orderkey AS o_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey AS o_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r = 2) b USING (o_orderkey)")
def turtle_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line numbers of each order as a collection; its first two members."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), " ").alias("n"))
    text = F.concat(F.lit(f"<{BASE}order/"), F.col("l_orderkey"), F.lit("> :lines ( "), F.col("n"), F.lit(" ) ."))
    store = _turtle(spark, lines.select(text.alias("value")), f"@prefix : <{VOCABULARY}> .")
    found = Engine(store).query(f"PREFIX r: <{RDF}> " + PREFIXES + "SELECT ?o ?first ?second WHERE { ?o e:lines ?l . ?l r:first ?first ; r:rest ?m . ?m r:first ?second }")
    return found.select("o", F.col("first").cast("int").alias("first"), F.col("second").cast("int").alias("second"))


@query("SELECT 'http://ex.org/supplier/' || s_suppkey AS s, s_suppkey % 3 = 0 AS lost FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT NULL, TRUE FROM supplier WHERE s_suppkey % 3 = 0")
def turtle_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the statements have an unknown prefix; the others are read, and each failure is reported."""
    name = F.when(F.col("s_suppkey") % 3 == 0, "nope:x").otherwise(_quoted("s_name"))
    path = fresh_path(spark, "ttl")
    text = F.concat(F.lit(f"<{BASE}supplier/"), F.col("s_suppkey"), F.lit(f"> <{VOCABULARY}name> "), name, F.lit(" ."))
    read(spark, sf_dir, "supplier").select(text.alias("value")).write.text(path)
    return read_turtle(spark, path, "").select("s.lex", F.col("corrupt").isNotNull().alias("lost")).withColumnRenamed("lex", "s")


# files


@query(f"SELECT c_name AS n, c_custkey % 50 = 0 AS skipped FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT '<{BASE}customer/' || c_custkey || '> broken .', TRUE FROM customer WHERE c_custkey % 50 = 0")
def load_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed N-Triples in which every fiftieth line is broken: the facts, and the lines that were left out."""
    path = fresh_path(spark, "load") + "/facts.nt.gz"
    good = F.concat(F.lit(f"<{BASE}customer/"), F.col("c_custkey"), F.lit(f"> <{VOCABULARY}name> "), _quoted("c_name"), F.lit(" ."))
    bad = F.concat(F.lit(f"<{BASE}customer/"), F.col("c_custkey"), F.lit("> broken ."))
    read(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 50 == 0, bad).otherwise(good).alias("value")).write.option("compression", "gzip").text(path)
    store = load(spark, path)
    found = Engine(store).query(PREFIXES + "SELECT ?n WHERE { ?c e:name ?n }")
    return found.select("n", F.lit(False).alias("skipped")).unionByName(store.skipped.select(F.col("stmt").alias("n"), F.lit(True).alias("skipped")))


@query("SELECT s, p, o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
def encoded_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as lines of three numbers; those with a part missing are lines of two."""
    path = fresh_path(spark, "encoded")
    read(spark, sf_dir, "triples").select(F.concat_ws(" ", *(F.col(c).cast("string") for c in "spo")).alias("value")).write.text(path)
    return read_encoded(spark, path)


@query("SELECT DISTINCT e.id, p.part FROM parts p JOIN dict d ON p.id = d.id JOIN dict e ON e.lex = d.lex WHERE d.kind <> 'L' AND e.kind <> 'L'")
def partition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graph partitions from two line-aligned files, one of texts and one of numbers."""
    path = fresh_path(spark, "parts")
    both = read(spark, sf_dir, "parts").join(read(spark, sf_dir, "dict").where("kind <> 'L'"), "id").select("lex", F.col("part").cast("string").alias("part"))
    both = stored(both.repartition(1), "aligned")
    for c in ("part", "lex"):
        both.coalesce(1).select(F.col(c).alias("value")).write.text(f"{path}/{c}")
    return file_parts(graph(spark, sf_dir), f"{path}/part", f"{path}/lex").distinct()


@query(_T + f"SELECT d0.lex || '|' || d1.lex || '|' || coalesce(d2.lex, '') AS line FROM {_pattern('a', 'cites')} LEFT JOIN {_pattern('b', 'label')} ON a.o = b.s {_lex('a.s', 'a.o', 'b.o')} WHERE coalesce(d2.lex, '') NOT LIKE '%' || chr(10) || '%'")
def result_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Solutions written as text, unbound values empty."""
    path = fresh_path(spark, "result")
    write_result(Engine(saved(spark, sf_dir)).query(PREFIXES + "SELECT ?s ?x ?l WHERE { ?s v:cites ?x . OPTIONAL { ?x v:label ?l } }"), path)
    return spark.read.text(path).toDF("line")


_EDGES = "(SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM t JOIN d ON d.id = t.o WHERE s <> o AND NOT (d.kind = 'L' AND coalesce(d.lang, '') = '' AND coalesce(d.dt, '') = ''))"


@query(_T + f", e AS {_EDGES}, v AS (SELECT DISTINCT unnest([a, b]) AS id FROM e) SELECT (SELECT count(*) FROM v) || ' ' || (SELECT count(*) FROM e) AS head, (SELECT count(*) FROM v) AS n_lists, 2 * (SELECT count(*) FROM e) AS n_neighbours, (SELECT count(*) FROM t WHERE s <> o AND s IN (SELECT id FROM v) AND o IN (SELECT id FROM v)) AS n_directed, (SELECT count(*) FROM v JOIN d USING (id)) AS n_texts")
def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three files for graph partitioners: header, neighbour lists, directed edges and texts, counted."""
    path = fresh_path(spark, "graph")
    export_graph(saved(spark, sf_dir), path)
    # The header is the file's first line; each other line is the list of a vertex, in their order.
    first, lists = f"{path}.mf", spark.read.text(f"{path}.mf")
    head = spark.read.text(first).limit(1)
    numbers = lists.agg((F.count(F.lit(1)) - 1).alias("n_lists"), (F.sum(F.size(F.split("value", " "))) - 2).cast("long").alias("n_neighbours"))
    directed = spark.read.text(f"{path}.idf").agg(F.count(F.lit(1)).alias("n_directed"))
    texts = spark.read.text(f"{path}.dict").agg(F.count(F.lit(1)).alias("n_texts"))
    return head.toDF("head").crossJoin(numbers).crossJoin(directed).crossJoin(texts)


# identity, partitions, statistics


@query(_T + "SELECT DISTINCT a.lex AS s, b.lex AS p, c.lex AS o FROM t JOIN d a ON a.id = t.s JOIN d b ON b.id = t.p JOIN d c ON c.id = t.o")
def identity_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose terms are told apart by their texts alone."""
    store = graph(spark, sf_dir)
    named = store.triples.select("s", "p", "o")
    for c in "spo":
        named = named.join(store.terms.select(F.col("id").alias(c), F.struct("kind", "lex", "lang", "dt").alias(f"{c}_term")), c)
    lexical = TripleStore.from_terms(named.select(*(F.col(f"{c}_term").alias(c) for c in "spo")), "lexical")
    return Engine(lexical).query("SELECT ?s ?p ?o WHERE { ?s ?p ?o }")


_SUBJECTS = "SELECT DISTINCT s AS id, TRUE AS placed FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL"


@query(_SUBJECTS)
def partition_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject in one of 16 partitions by hash."""
    return hash_parts(graph(spark, sf_dir), 16).select("id", F.col("part").between(100, 115).alias("placed"))


@query(_SUBJECTS)
def partition_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subject in one partition by label propagation; partitions are numbered from 100 without gaps."""
    parts = stored(label_parts(graph(spark, sf_dir)), "parts")
    top = parts.agg(F.count_distinct("part").alias("n"))
    return parts.crossJoin(F.broadcast(top)).select("id", F.col("part").between(F.lit(100), F.col("n") + 99).alias("placed"))


def _var(name: str) -> Var:
    return Var(name)


def _v(name: str) -> Term:
    return Term("I", V + name)


@query(_T + f"SELECT 'object' AS what, count(*) AS n FROM t WHERE p = 100 AND o = {_p('Station')} UNION ALL SELECT 'any', count(*) FROM t WHERE o = {_p('Project')} UNION ALL SELECT 'subject', count(*) FROM t WHERE s = (SELECT id FROM dict WHERE kind = 'I' AND lex = 'http://graph.example/Station/central-register')")
def stats_bound_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact numbers of facts of patterns with a bound subject or object, as the planner asks for them."""
    patterns = {"object": Pattern(_var("s"), Term("I", RDF + "type"), _v("Station")), "any": Pattern(_var("s"), _var("p"), _v("Project")), "subject": Pattern(Term("I", "http://graph.example/Station/central-register"), _var("p"), _var("o"))}
    store = saved(spark, sf_dir)
    store.look_up({t for p in patterns.values() for t in (p.s, p.p, p.o) if isinstance(t, Term)})
    counts = exact_counts(store, list(patterns.values()))
    return spark.createDataFrame([(k, int(counts[p])) for k, p in patterns.items()], "what string, n long")


_JOINS = {"star": ("label", "s", "note", "s"), "path": ("partOf", "o", "label", "s"), "objects": ("cites", "o", "fundedBy", "o")}


@query(_T + " UNION ALL ".join(f"SELECT '{k}' AS what, greatest(1, count(*)) AS n FROM {_pattern('a', p)} JOIN {_pattern('b', q)} ON a.{x} = b.{y}" for k, (p, x, q, y) in _JOINS.items()))
def stats_join_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planner's estimates of joins of two patterns of known predicates, which are exact."""
    store, rows = saved(spark, sf_dir), []
    for k, (p, x, q, y) in _JOINS.items():
        a = Pattern(*(_var("v") if x == "s" else _var("a"), _v(p), _var("v") if x == "o" else _var("a")))
        b = Pattern(*(_var("v") if y == "s" else _var("b"), _v(q), _var("v") if y == "o" else _var("b")))
        est = estimates(store, [a, b])
        rows.append((k, round(est.card(a) * est.card(b) * est.selectivity(a, b))))
    return spark.createDataFrame(rows, "what string, n long")


@query(_T + "SELECT (SELECT count(*) FROM t) AS n_facts, (SELECT count(*) FROM d) AS n_terms, (SELECT count(DISTINCT p) FROM t) AS n_predicates")
def store_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph tables made a store: facts once, two layouts, dictionary, statistics and summary, all written and opened again."""
    store = prepared(graph(spark, sf_dir)).save(fresh_path(spark, "store"))
    facts, terms = store.triples.agg(F.count(F.lit(1)).alias("n_facts")), store.terms.agg(F.count(F.lit(1)).alias("n_terms"))
    return facts.crossJoin(terms).crossJoin(store.predicate_stats.agg(F.count(F.lit(1)).alias("n_predicates")))


@query("SELECT n_name AS n FROM nation")
def ntriples_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder that was written as N-Triples is loaded like a file."""
    path = fresh_path(spark, "nt") + "/facts.nt"
    write_ntriples(TripleStore.from_terms(tables_statements(spark, sf_dir, "nation")), path)
    return Engine(load(spark, path)).query(PREFIXES + "SELECT ?n WHERE { ?x a e:Nation ; e:name ?n }")


QUERIES.update({k: _GRAPH_QUERIES[k] for k in ("object_number", "syntax_where", "optional_join", "union_unbound_join")})
SQL.update({k: _GRAPH_SQL[k] for k in ("object_number", "syntax_where", "optional_join", "union_unbound_join")})
