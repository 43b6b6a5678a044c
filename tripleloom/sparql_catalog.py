"""Queries of the SPARQL engine, one for each operator, and the SQL that their results are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleloom.plans.engine import Engine
from tripleloom.plans.stats import analyse, join_stats, predicate_stats, summary_stats
from tripleloom.plans.summary import summary_edges
from tripleloom.runtime import exists, fresh_path, read, stored
from tripleloom.sources.files import graph_edges, write_ntriples
from tripleloom.sources.tables import tables_statements
from tripleloom.store import TripleStore

V = "http://graph.example/v#"
PREFIXES = f"PREFIX v: <{V}> PREFIX e: <http://ex.org/v#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

#: The encoded facts as a set, with texts.
_T = "WITH t AS (SELECT DISTINCT s, p, o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL), d AS (SELECT id, kind, lex, lang, dt FROM dict) "


def graph(spark: SparkSession, sf_dir: str) -> TripleStore:
    return TripleStore.from_encoded(read(spark, sf_dir, "triples"), read(spark, sf_dir, "dict"))


_stores: dict[tuple, TripleStore] = {}


def prepared(store: TripleStore) -> TripleStore:
    """A store with its facts written once, statistics and summary; ready to be saved."""
    frozen = TripleStore(stored(store.triples, "facts"), store.terms if not store.hashed else stored(store.terms, "terms"), store.identity, store.hashed)
    frozen.summary = summary_edges(frozen)
    return analyse(frozen)


def saved(spark: SparkSession, sf_dir: str, *tables: str) -> TripleStore:
    """The store of the graph tables, or of relational ones, with statistics and summary: loaded once in a session, as a store
    is that is queried many times. It is made anew where its folder isn't there any more."""
    key = (spark.sparkContext.applicationId, sf_dir, *tables)
    if key not in _stores or not exists(spark, f"{_stores[key].path}/about/_SUCCESS"):
        store = TripleStore.from_terms(tables_statements(spark, sf_dir, *tables)) if tables else graph(spark, sf_dir)
        _stores[key] = prepared(store).save(fresh_path(spark, "store", keep=True))
    return _stores[key]


def _p(name: str) -> str:
    return f"(SELECT id FROM dict WHERE kind = 'I' AND lex = '{V}{name}')"


def _pattern(alias: str, name: str) -> str:
    return f"(SELECT s, o FROM t WHERE p = {_p(name)}) {alias}"


def _lex(*ids: str) -> str:
    return " ".join(f"LEFT JOIN d d{i} ON d{i}.id = {x}" for i, x in enumerate(ids))


def on_graph(name: str, text: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: Engine(saved(spark, sf_dir)).query(PREFIXES + text)
    SQL[name] = _T + sql


def on_tables(name: str, tables: tuple[str, ...], text: str, sql: str, doubles: tuple[str, ...] = (), longs: tuple[str, ...] = ()) -> None:
    """Numbers are compared as numbers, as their texts differ between engines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(saved(spark, sf_dir, *tables)).query(PREFIXES + text)
        casts = {c: F.col(c).cast("double") for c in doubles} | {c: F.col(c).cast("long") for c in longs}
        return df.withColumns(casts) if casts else df

    QUERIES[name] = run
    SQL[name] = sql


# scans

on_graph("scan_pred", "SELECT ?s ?o WHERE { ?s v:code ?o }", f"SELECT d0.lex AS s, d1.lex AS o FROM {_pattern('a', 'code')} {_lex('a.s', 'a.o')}")
on_graph("scan_pred_obj", "SELECT ?s WHERE { ?s a v:Station }", f"SELECT d0.lex AS s FROM t {_lex('t.s')} WHERE t.p = 100 AND t.o = {_p('Station')}")
on_graph("scan_subj", "SELECT ?p ?o WHERE { <http://graph.example/Station/central-register> ?p ?o }", f"SELECT d0.lex AS p, d1.lex AS o FROM t {_lex('t.p', 't.o')} WHERE t.s = (SELECT id FROM dict WHERE lex = 'http://graph.example/Station/central-register' AND kind = 'I')")
on_graph("scan_var_pred", "SELECT ?s ?p WHERE { ?s ?p v:Project }", f"SELECT d0.lex AS s, d1.lex AS p FROM t {_lex('t.s', 't.p')} WHERE t.o = {_p('Project')}")
on_graph("scan_fact", "SELECT ?p WHERE { <http://graph.example/Station/central-register> v:observedBy <http://graph.example/Reading/0> . <http://graph.example/Station/central-register> ?p <http://graph.example/Reading/27> }", "SELECT p.lex AS p FROM t JOIN d s ON t.s = s.id JOIN d p ON t.p = p.id JOIN d o ON t.o = o.id WHERE s.lex = 'http://graph.example/Station/central-register' AND o.lex = 'http://graph.example/Reading/27' AND EXISTS (SELECT 1 FROM t x JOIN d s ON x.s = s.id JOIN d o ON x.o = o.id WHERE s.lex = 'http://graph.example/Station/central-register' AND o.lex = 'http://graph.example/Reading/0' AND x.p = " + _p("observedBy") + ")")
on_graph("scan_unknown_constant", "SELECT ?s WHERE { ?s v:noSuchPredicate ?o }", "SELECT '' AS s WHERE false")
on_graph("scan_aggregated", "SELECT DISTINCT ?s WHERE { ?s v:observedBy ?x }", f"SELECT d0.lex AS s FROM (SELECT DISTINCT s FROM {_pattern('a', 'observedBy')}) x {_lex('x.s')}")
on_graph("scan_fully_aggregated", "SELECT DISTINCT ?p WHERE { ?s ?p ?o }", f"SELECT d0.lex AS p FROM (SELECT DISTINCT p FROM t) x {_lex('x.p')}")
on_graph("select_star", "SELECT * WHERE { ?b v:near ?a . ?a v:cites [] }", f"SELECT d0.lex AS a, d1.lex AS b FROM {_pattern('x', 'near')} JOIN {_pattern('y', 'cites')} ON x.o = y.s {_lex('x.o', 'x.s')}")

# joins

on_graph("join_star_ss", "SELECT ?s ?l ?n WHERE { ?s v:label ?l . ?s v:note ?n }", f"SELECT d0.lex AS s, d1.lex AS l, d2.lex AS n FROM {_pattern('a', 'label')} JOIN {_pattern('b', 'note')} ON a.s = b.s {_lex('a.s', 'a.o', 'b.o')}")
on_graph("join_star_oo", "SELECT ?a ?b ?x WHERE { ?a v:cites ?x . ?b v:fundedBy ?x }", f"SELECT d0.lex AS a, d1.lex AS b, d2.lex AS x FROM {_pattern('a', 'cites')} JOIN {_pattern('b', 'fundedBy')} ON a.o = b.o {_lex('a.s', 'b.s', 'a.o')}")
on_graph("join_path_os", "SELECT ?a ?l WHERE { ?a v:partOf ?b . ?b v:label ?l }", f"SELECT d0.lex AS a, d1.lex AS l FROM {_pattern('a', 'partOf')} JOIN {_pattern('b', 'label')} ON a.o = b.s {_lex('a.s', 'b.o')}")
on_graph("join_path_3", "SELECT ?x ?z WHERE { ?x v:cites ?y . ?y v:linkedTo ?w . ?w v:near ?z }", f"SELECT d0.lex AS x, d1.lex AS z FROM {_pattern('a', 'cites')} JOIN {_pattern('b', 'linkedTo')} ON a.o = b.s JOIN {_pattern('c', 'near')} ON b.o = c.s {_lex('a.s', 'c.o')}")
on_graph("join_cycle", "SELECT ?a ?b ?c WHERE { ?a v:linkedTo ?b . ?b ?q ?c . ?c ?r ?a . FILTER (?a != ?b && ?b != ?c) }", f"SELECT d0.lex AS a, d1.lex AS b, d2.lex AS c FROM {_pattern('x', 'linkedTo')} JOIN t y ON x.o = y.s JOIN t z ON y.o = z.s AND z.o = x.s {_lex('x.s', 'x.o', 'y.o')} WHERE x.s <> x.o AND y.s <> y.o")
on_graph("join_multi_var", "SELECT ?a ?b WHERE { ?a v:linkedTo ?b . ?a v:observedBy ?b }", f"SELECT d0.lex AS a, d1.lex AS b FROM {_pattern('x', 'linkedTo')} JOIN {_pattern('y', 'observedBy')} ON x.s = y.s AND x.o = y.o {_lex('x.s', 'x.o')}")
on_graph("join_predicate_var", "SELECT ?a ?b ?p WHERE { ?a ?p v:Project . ?b ?p v:Person . ?a v:near ?b }", f"SELECT d0.lex AS a, d1.lex AS b, d2.lex AS p FROM t x JOIN t y ON x.p = y.p JOIN {_pattern('z', 'near')} ON z.s = x.s AND z.o = y.s {_lex('x.s', 'y.s', 'x.p')} WHERE x.o = {_p('Project')} AND y.o = {_p('Person')}")
on_graph("join_self_var", "SELECT ?x ?p WHERE { ?x ?p ?x }", f"SELECT d0.lex AS x, d1.lex AS p FROM t {_lex('t.s', 't.p')} WHERE t.s = t.o")
on_graph("blank_node_pattern", "SELECT ?l WHERE { [] v:partOf [ v:label ?l ] . _:x v:note ?l }", f"SELECT d0.lex AS l FROM {_pattern('a', 'partOf')} JOIN {_pattern('b', 'label')} ON a.o = b.s JOIN {_pattern('c', 'note')} ON c.o = b.o {_lex('b.o')}")
on_graph("prefix_lists", "SELECT ?s ?a ?b ?c WHERE { ?s v:label ?a , ?b ; v:code ?c . }", f"SELECT d0.lex AS s, d1.lex AS a, d2.lex AS b, d3.lex AS c FROM {_pattern('x', 'label')} JOIN {_pattern('y', 'label')} ON x.s = y.s JOIN {_pattern('z', 'code')} ON z.s = x.s {_lex('x.s', 'x.o', 'y.o', 'z.o')}")
on_tables("join_cross", ("region", "nation"), "SELECT ?r ?n WHERE { ?x a e:Region . ?x e:name ?r . ?y a e:Nation . ?y e:name ?n }", "SELECT r_name AS r, n_name AS n FROM region, nation")
on_tables("join_star_path", ("region", "nation", "customer"), "SELECT ?cname ?nname WHERE { ?c a e:Customer . ?c e:name ?cname . ?c e:nation ?n . ?n e:name ?nname . ?n e:region <http://ex.org/region/1> }", "SELECT c_name AS cname, n_name AS nname FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
on_tables("join_orders", ("nation", "customer", "orders"), 'SELECT ?o ?n WHERE { ?o e:customer ?c . ?o e:status "F" . ?o e:priority "1-URGENT" . ?c e:nation ?x . ?x e:name ?n }', "SELECT 'http://ex.org/order/' || o_orderkey AS o, n_name AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")

# filters

on_tables("filter_cmp", ("customer",), "SELECT ?c ?b WHERE { ?c e:acctbal ?b . FILTER (?b >= 9000.5) }", "SELECT 'http://ex.org/customer/' || c_custkey AS c, c_acctbal AS b FROM customer WHERE c_acctbal >= 9000.5", ("b",))
on_tables("filter_arith", ("part",), "SELECT ?p ?s WHERE { ?p e:size ?s . FILTER (?s * 2 + 1 > 90 && -?s / 4 < -11.5) }", "SELECT 'http://ex.org/part/' || p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE p_size * 2 + 1 > 90 AND -p_size / 4.0 < -11.5", (), ("s",))
on_tables("filter_bool", ("part",), 'SELECT ?p ?s WHERE { ?p e:size ?s ; e:brand ?b . FILTER ((?s < 5 || ?s > 45) && !(?b = "Brand#11")) }', "SELECT 'http://ex.org/part/' || p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part WHERE (p_size < 5 OR p_size > 45) AND p_brand <> 'Brand#11'", (), ("s",))
on_tables("filter_error_or", ("part",), "SELECT ?p WHERE { ?p e:name ?n ; e:size ?s . FILTER (?n + 1 > 0 || ?s = 7) }", "SELECT 'http://ex.org/part/' || p_partkey AS p FROM part WHERE p_size = 7")
on_tables("filter_regex", ("part",), 'SELECT ?n WHERE { ?p e:name ?n . FILTER regex(?n, "^(RED|blue) .*T$", "i") }', "SELECT p_name AS n FROM part WHERE regexp_matches(p_name, '(?i)^(RED|blue) .*T$')")
on_tables("filter_in", ("nation",), 'SELECT ?n WHERE { ?x a e:Nation ; e:name ?n ; e:region ?r . FILTER in(?r, <http://ex.org/region/0>, <http://ex.org/region/3>) FILTER (?n NOT IN ("NATION_3", "NATION_8")) }', "SELECT n_name AS n FROM nation WHERE n_regionkey IN (0, 3) AND n_name NOT IN ('NATION_3', 'NATION_8')")
on_tables("filter_str", ("nation",), 'SELECT ?n WHERE { ?x e:name ?n ; e:region ?r . FILTER (str(?r) = "http://ex.org/region/1") }', "SELECT n_name AS n FROM nation WHERE n_regionkey = 1")
on_tables("filter_datetime", ("orders",), 'SELECT ?o WHERE { ?o e:orderdate ?d . FILTER (?d < "1996-03-01T00:00:00"^^xsd:dateTime && ?d > "1996-01-01T00:00:00"^^xsd:dateTime) }', "SELECT 'http://ex.org/order/' || o_orderkey AS o FROM orders WHERE o_orderdate < TIMESTAMP '1996-03-01' AND o_orderdate > TIMESTAMP '1996-01-01'")
on_tables("filter_datatype", ("part",), "SELECT ?p ?v WHERE { ?p ?x ?v . FILTER (datatype(?v) = xsd:double) }", "SELECT 'http://ex.org/part/' || p_partkey AS p, p_retailprice AS v FROM part WHERE p_retailprice IS NOT NULL", ("v",))
on_tables("filter_bound", ("documents",), "SELECT ?d ?p WHERE { ?d e:paper ?p . OPTIONAL { ?d e:shelf ?s } FILTER (!bound(?s)) }", "SELECT 'http://ex.org/document/' || doc_id AS d, paper_no AS p FROM documents WHERE paper_no IS NOT NULL AND shelf_code IS NULL")
on_tables("filter_sameterm", ("nation",), "SELECT ?a ?b WHERE { ?x e:region ?a . ?x e:name ?b . FILTER sameTerm(?a, <http://ex.org/region/2>) }", "SELECT 'http://ex.org/region/2' AS a, n_name AS b FROM nation WHERE n_regionkey = 2")
on_graph("filter_lang", 'SELECT ?s ?o WHERE { ?s v:label ?o . FILTER (lang(?o) = "de") }', f"SELECT d0.lex AS s, d1.lex AS o FROM {_pattern('a', 'label')} {_lex('a.s', 'a.o')} WHERE d1.kind = 'L' AND d1.lang = 'de'")
on_graph("filter_langmatches", 'SELECT ?s ?o WHERE { ?s ?p ?o . FILTER langMatches(lang(?o), "EN") }', f"SELECT d0.lex AS s, d1.lex AS o FROM t {_lex('t.s', 't.o')} WHERE d1.kind = 'L' AND (lower(d1.lang) = 'en' OR lower(d1.lang) LIKE 'en-%')")
on_graph("filter_isiri", "SELECT ?s ?o WHERE { ?s v:homepage ?o . FILTER isIRI(?o) }", f"SELECT d0.lex AS s, d1.lex AS o FROM {_pattern('a', 'homepage')} {_lex('a.s', 'a.o')} WHERE d1.kind = 'I'")
on_graph("filter_isblank", "SELECT ?s ?o WHERE { ?s v:replacedBy ?o . FILTER isBLANK(?o) }", f"SELECT d0.lex AS s, d1.lex AS o FROM {_pattern('a', 'replacedBy')} {_lex('a.s', 'a.o')} WHERE d1.kind = 'B'")
on_graph("filter_isliteral", "SELECT ?s ?o WHERE { ?s v:label ?o . FILTER (isLITERAL(?o) && !(lang(?o) != \"\")) }", f"SELECT d0.lex AS s, d1.lex AS o FROM {_pattern('a', 'label')} {_lex('a.s', 'a.o')} WHERE d1.kind = 'L' AND coalesce(d1.lang, '') = ''")
on_graph("filter_join", "SELECT ?a ?b WHERE { ?a v:staffCount ?x . ?a v:partOf ?b . ?b v:staffCount ?y . FILTER (?x < ?y) }", f"SELECT d0.lex AS a, d1.lex AS b FROM {_pattern('x', 'staffCount')} JOIN {_pattern('m', 'partOf')} ON m.s = x.s JOIN {_pattern('y', 'staffCount')} ON y.s = m.o {_lex('x.s', 'm.o', 'x.o', 'y.o')} WHERE d2.dt = 'http://www.w3.org/2001/XMLSchema#integer' AND d3.dt = 'http://www.w3.org/2001/XMLSchema#integer' AND regexp_matches(d2.lex, '^[+-]?[0-9]+$') AND regexp_matches(d3.lex, '^[+-]?[0-9]+$') AND CAST(d2.lex AS HUGEINT) < CAST(d3.lex AS HUGEINT)")

# modifiers

on_graph("distinct", "SELECT DISTINCT ?p ?t WHERE { ?s ?p ?o . ?s a ?t }", f"SELECT d0.lex AS p, d1.lex AS t FROM (SELECT DISTINCT x.p, y.o FROM t x JOIN t y ON x.s = y.s AND y.p = 100) z {_lex('z.p', 'z.o')}")
on_graph("reduced", "SELECT REDUCED ?o WHERE { ?s a ?o }", f"SELECT d0.lex AS o FROM t {_lex('t.o')} WHERE t.p = 100")
on_graph("count_modifier", "SELECT COUNT ?p ?t WHERE { ?s ?p ?o . ?s a ?t }", f"SELECT d0.lex AS p, d1.lex AS t, z.n AS count FROM (SELECT x.p, y.o, count(*) AS n FROM t x JOIN t y ON x.s = y.s AND y.p = 100 GROUP BY x.p, y.o) z {_lex('z.p', 'z.o')}")
on_graph("duplicates_modifier", "SELECT DUPLICATES ?s WHERE { ?s v:label ?o }", f"SELECT d0.lex AS s, z.n AS count FROM (SELECT s, count(*) AS n FROM {_pattern('a', 'label')} GROUP BY s HAVING count(*) > 1) z {_lex('z.s')}")
on_tables("order_limit", ("customer",), "SELECT ?c ?b WHERE { ?c e:acctbal ?b } ORDER BY DESC(?b) ?c LIMIT 25", "SELECT 'http://ex.org/customer/' || c_custkey AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c LIMIT 25", ("b",))
on_tables("order_limit_offset", ("part",), "SELECT ?p ?s WHERE { ?p e:size ?s } ORDER BY ASC(?s) DESC(?p) LIMIT 30 OFFSET 10", "SELECT 'http://ex.org/part/' || p_partkey AS p, CAST(p_size AS BIGINT) AS s FROM part ORDER BY p_size, p DESC LIMIT 30 OFFSET 10", (), ("s",))
on_tables("order_count_limit", ("customer",), "SELECT COUNT ?n WHERE { ?c e:nation ?n } ORDER BY DESC(count) ?n LIMIT 7", "SELECT 'http://ex.org/nation/' || c_nationkey AS n, count(*) AS count FROM customer GROUP BY c_nationkey ORDER BY count DESC, n LIMIT 7")

# unions and optional parts

on_graph("union_two", "SELECT ?s ?x WHERE { { ?s v:cites ?x } UNION { ?s v:near ?x } }", f"SELECT d0.lex AS s, d1.lex AS x FROM (SELECT s, o FROM {_pattern('a', 'cites')} UNION ALL SELECT s, o FROM {_pattern('b', 'near')}) z {_lex('z.s', 'z.o')}")
on_graph("union_three", "SELECT ?s ?a ?b WHERE { { ?s v:cites ?a } UNION { ?s v:near ?b } UNION { ?s v:uses ?a . ?s v:note ?b } }", f"SELECT d0.lex AS s, d1.lex AS a, d2.lex AS b FROM (SELECT s, o AS a, NULL AS b FROM {_pattern('a', 'cites')} UNION ALL SELECT s, NULL, o FROM {_pattern('b', 'near')} UNION ALL SELECT c.s, c.o, e.o FROM {_pattern('c', 'uses')} JOIN {_pattern('e', 'note')} ON c.s = e.s) z {_lex('z.s', 'z.a', 'z.b')}")
on_graph("union_join", "SELECT ?s ?x ?l WHERE { { ?s v:cites ?x } UNION { ?s v:near ?x } ?s v:label ?l }", f"SELECT d0.lex AS s, d1.lex AS x, d2.lex AS l FROM (SELECT s, o FROM {_pattern('a', 'cites')} UNION ALL SELECT s, o FROM {_pattern('b', 'near')}) z JOIN {_pattern('c', 'label')} ON z.s = c.s {_lex('z.s', 'z.o', 'c.o')}")
on_graph("union_empty", "SELECT ?s ?x WHERE { { ?s v:cites ?x } UNION { ?s v:noSuchPredicate ?x } }", f"SELECT d0.lex AS s, d1.lex AS x FROM {_pattern('a', 'cites')} {_lex('a.s', 'a.o')}")
on_graph("nested_groups", "SELECT ?s ?x WHERE { { { ?s v:cites ?x } } { ?s v:label ?l } }", f"SELECT d0.lex AS s, d1.lex AS x FROM {_pattern('a', 'cites')} JOIN {_pattern('b', 'label')} ON a.s = b.s {_lex('a.s', 'a.o')}")
on_graph("optional_left", "SELECT ?s ?x ?l WHERE { ?s v:cites ?x . OPTIONAL { ?x v:label ?l } }", f"SELECT d0.lex AS s, d1.lex AS x, d2.lex AS l FROM {_pattern('a', 'cites')} LEFT JOIN {_pattern('b', 'label')} ON a.o = b.s {_lex('a.s', 'a.o', 'b.o')}")
on_tables("optional_filter", ("nation", "customer"), "SELECT ?n ?c WHERE { ?x a e:Nation ; e:name ?n . OPTIONAL { ?c e:nation ?x ; e:acctbal ?b . FILTER (?b > 9900) } }", "SELECT n_name AS n, 'http://ex.org/customer/' || c_custkey AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900")

# statistics and the summary graph

_PAIRS = {"path": ("o", "s"), "star1": ("s", "s"), "star2": ("o", "o")}


def _stats_join(name: str) -> Run:
    return lambda spark, sf_dir: join_stats(graph(spark, sf_dir).triples).where(F.col(name) > 0).select("p1", "p2", name)


QUERIES["stats_pred_card"] = lambda spark, sf_dir: predicate_stats(graph(spark, sf_dir).triples)
SQL["stats_pred_card"] = _T + "SELECT p, count(*) AS n, count(DISTINCT s) AS n_s, count(DISTINCT o) AS n_o FROM t GROUP BY p"
for _name, (_a, _b) in _PAIRS.items():
    QUERIES[f"stats_join_{_name}"] = _stats_join(_name)
    SQL[f"stats_join_{_name}"] = _T + f", x AS (SELECT p, {_a} AS v, count(*) AS c FROM t GROUP BY ALL), y AS (SELECT p, {_b} AS v, count(*) AS c FROM t GROUP BY ALL) SELECT x.p AS p1, y.p AS p2, CAST(sum(x.c * y.c) AS BIGINT) AS {_name} FROM x JOIN y ON x.v = y.v GROUP BY ALL"
_F = "WITH t AS (SELECT s, p, o, max(s_part) AS s_part, max(o_part) AS o_part FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL GROUP BY s, p, o) "
QUERIES["stats_summary_card"] = lambda spark, sf_dir: summary_stats(graph(spark, sf_dir).triples)
SQL["stats_summary_card"] = _F + "SELECT p, s_part, count(*) AS n FROM t GROUP BY ALL"
QUERIES["summary_edges"] = lambda spark, sf_dir: summary_edges(graph(spark, sf_dir))
SQL["summary_edges"] = _F + "SELECT DISTINCT p, coalesce(s_part, -1) AS s_part, coalesce(o_part, -1) AS o_part FROM t"


def summary_pruned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path query with joins ordered by statistics and scans pruned by the summary graph; the same rows as without."""
    return Engine(saved(spark, sf_dir), summary=True).query(PREFIXES + "SELECT ?a ?b ?l WHERE { ?a v:partOf ?b . ?b v:cites ?c . ?c v:label ?l }")


QUERIES["summary_pruned_query"] = summary_pruned_query
SQL["summary_pruned_query"] = _T + f"SELECT d0.lex AS a, d1.lex AS b, d2.lex AS l FROM {_pattern('x', 'partOf')} JOIN {_pattern('y', 'cites')} ON x.o = y.s JOIN {_pattern('z', 'label')} ON z.s = y.o {_lex('x.s', 'x.o', 'z.o')}"
QUERIES["metis_edges"] = lambda spark, sf_dir: graph_edges(graph(spark, sf_dir))
SQL["metis_edges"] = _T + "SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM t JOIN d ON d.id = t.o WHERE s <> o AND NOT (d.kind = 'L' AND coalesce(d.lang, '') = '' AND coalesce(d.dt, '') = '')"

# sources, sinks and the dictionary


def _names(store: TripleStore) -> DataFrame:
    return Engine(store).query(PREFIXES + "SELECT ?n ?r WHERE { ?x a e:Nation ; e:name ?n ; e:region ?y . ?y e:name ?r }")


def ntriples_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "nt")
    write_ntriples(TripleStore.from_terms(tables_statements(spark, sf_dir, "region", "nation")), f"{path}/facts.nt")
    from tripleloom.sources.files import statements
    from tripleloom.sources.ntriples import read_ntriples

    return _names(TripleStore.from_terms(statements(read_ntriples(spark, f"{path}/facts.nt", ""))))


def ntriples_graph_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All encoded facts with their texts, tags and datatypes, written as N-Triples and read again."""
    path = fresh_path(spark, "nt")
    write_ntriples(graph(spark, sf_dir), f"{path}/facts.nt")
    from tripleloom.sources.files import statements
    from tripleloom.sources.ntriples import read_ntriples

    nodes = statements(read_ntriples(spark, f"{path}/facts.nt", ""))
    return nodes.select(F.col("s.kind").alias("kind"), F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.kind").alias("o_kind"), F.col("o.lex").alias("o"), F.col("o.lang").alias("lang"), F.col("o.dt").alias("dt"))


def turtle_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions written as Turtle with prefixes, lists and nested nodes, and read again."""
    path = fresh_path(spark, "ttl")
    quoted: Callable[[str], Column] = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    regions = read(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey"), F.lit(" a e:Region ; e:name "), quoted("r_name"), F.lit(" .")).alias("value"))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("[] a e:Nation, e:Place ;\n  e:region r:"), F.col("n_regionkey"), F.lit(" ;\n  e:name "), quoted("n_name"), F.lit(" .")).alias("value"))
    text = regions.unionByName(nations).agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value"))
    head = "@prefix e: <http://ex.org/v#> .\nPREFIX r: <http://ex.org/region/>\n"
    text.select(F.concat(F.lit(head), "value").alias("value")).write.text(f"{path}/facts.ttl")
    from tripleloom.sources.turtle import read_turtle

    return _names(TripleStore.from_terms(read_turtle(spark, f"{path}/facts.ttl", "").where("corrupt IS NULL")))


def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the parts' names, encoded and decoded."""
    store = TripleStore.from_terms(tables_statements(spark, sf_dir, "part"))
    store.check()
    return Engine(store).query(PREFIXES + "SELECT ?p ?n WHERE { ?p e:name ?n }")


def store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with statistics saved in its two layouts, loaded and queried from the object's side."""
    store = analyse(TripleStore.from_terms(tables_statements(spark, sf_dir, "nation", "customer"))).save(fresh_path(spark, "store"))
    return Engine(store).query(PREFIXES + "SELECT ?c WHERE { ?c e:nation <http://ex.org/nation/3> . ?c e:mktsegment ?m }")


for _q in (ntriples_roundtrip, turtle_roundtrip):
    QUERIES[_q.__name__] = _q
    SQL[_q.__name__] = "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"
QUERIES["dict_roundtrip"] = dict_roundtrip
SQL["dict_roundtrip"] = "SELECT 'http://ex.org/part/' || p_partkey AS p, p_name AS n FROM part"
QUERIES["store_roundtrip"] = store_roundtrip
SQL["store_roundtrip"] = "SELECT 'http://ex.org/customer/' || c_custkey AS c FROM customer WHERE c_nationkey = 3 AND c_mktsegment IS NOT NULL"

# own functions


def udf_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(saved(spark, sf_dir, "part"))
    engine.register_function("http://ex.org/f#near", lambda x, y: F.abs(x - y) <= 2, ("number", "number"), "flag")
    return engine.query(PREFIXES + "SELECT ?p WHERE { ?p e:size ?s . FILTER <http://ex.org/f#near>(?s, 20) }")


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers up to each part's size."""
    engine = Engine(saved(spark, sf_dir, "part"))
    engine.register_table_function("upto", lambda n: F.when(n >= 1, F.sequence(F.lit(1).cast("long"), n.cast("long"))), ("number",), ("number",))
    df = engine.query(PREFIXES + 'SELECT ?p ?i WHERE { ?p e:size ?s . FILTER <urn:x/tableFunction>("upto", 1, ?s, ?i) }')
    return df.withColumn("i", F.col("i").cast("long"))


QUERIES["udf_filter"] = udf_filter
SQL["udf_filter"] = "SELECT 'http://ex.org/part/' || p_partkey AS p FROM part WHERE abs(p_size - 20) <= 2"
QUERIES["table_function"] = table_function
SQL["table_function"] = "SELECT 'http://ex.org/part/' || p_partkey AS p, unnest(generate_series(1, CAST(p_size AS BIGINT))) AS i FROM part"
QUERIES["ntriples_graph_roundtrip"] = ntriples_graph_roundtrip
SQL["ntriples_graph_roundtrip"] = _T + "SELECT a.kind AS kind, a.lex AS s, b.lex AS p, c.kind AS o_kind, c.lex AS o, c.lang AS lang, c.dt AS dt FROM t JOIN d a ON a.id = t.s JOIN d b ON b.id = t.p JOIN d c ON c.id = t.o"
