import pytest

from tripleloom.functions.xsd import RDF, XSD
from tripleloom.plans.algebra import Call, Pattern, TableCall, Term, Var
from tripleloom.plans.parser import SparqlError, parse


def test_prologue_lists_and_terms():
    q = parse("""BASE <http://b/> PREFIX p: <v#> PREFIX : <http://e/>
      SELECT DISTINCT ?x $y WHERE { ?x a p:C ; p:q 'a'@EN , "b\\n"^^p:t , 1 , -2.5 , 1e3 , true ; . :s <rel> ?y . } # end""")
    x, y = Var("x"), Var("y")
    assert q.modifier == "distinct" and q.select == [x, y]
    p = Term("I", "http://b/v#q")
    assert q.where.patterns == [
        Pattern(x, Term("I", RDF + "type"), Term("I", "http://b/v#C")),
        Pattern(x, p, Term("L", "a", "en")),
        Pattern(x, p, Term("L", "b\n", None, "http://b/v#t")),
        Pattern(x, p, Term("L", "1", None, XSD + "integer")),
        Pattern(x, p, Term("L", "-2.5", None, XSD + "decimal")),
        Pattern(x, p, Term("L", "1e3", None, XSD + "double")),
        Pattern(x, p, Term("L", "true", None, XSD + "boolean")),
        Pattern(Term("I", "http://e/s"), Term("I", "http://b/rel"), y),
    ]


def test_blank_nodes_are_hidden_variables():
    q = parse("SELECT * WHERE { [] <p> [ <q> ?z ; <r> _:a ] . _:a <s> ?y . [ <t> ?y ] . }")
    assert q.select == [Var("y"), Var("z")]
    hidden = {t for p in q.where.patterns for t in (p.s, p.o) if isinstance(t, Var) and t.hidden}
    assert len(hidden) == 4 and len(q.where.patterns) == 5


def test_groups():
    q = parse("SELECT ?x WHERE { { { ?x <p> ?y } } { ?x <a> ?b } UNION { ?x <c> ?d } UNION { } OPTIONAL { ?x <o> ?v FILTER (?v > 1) } }")
    assert len(q.where.patterns) == 1 and len(q.where.unions) == 1 and len(q.where.unions[0]) == 3
    assert len(q.where.optionals) == 1 and len(q.where.optionals[0].filters) == 1


def test_expression_precedence():
    q = parse("SELECT ?x WHERE { ?x <p> ?y FILTER (!bound(?y) || ?y + 2 * 3 <= -?x && in(?y, 1, 2)) }")
    e = q.where.filters[0]
    assert e.name == "||" and e.args[0] == Call("!", (Call("bound", (Var("y"),)),))
    both = e.args[1]
    assert both.name == "&&" and both.args[0].name == "<=" and both.args[1].name == "in"
    assert both.args[0].args[0].name == "+" and both.args[0].args[0].args[1].name == "*"
    assert both.args[0].args[1] == Call("minus", (Var("x"),))


def test_conjuncts_are_split_and_calls_kept():
    q = parse("SELECT ?x WHERE { ?x <p> ?y . FILTER (?y > 1 && ?y < 5 && <http://f>(?y, 'a')) FILTER regex(?y, \"a\", \"i\") . FILTER (?y NOT IN (1)) }")
    assert [f.name for f in q.where.filters] == [">", "<", "http://f", "regex", "!"]


def test_order_limit_modifier():
    q = parse("select count ?x where { ?x <p> ?y } order by desc(count) ?x asc(?y) limit 5 offset 2")
    assert q.modifier == "count" and q.order == [(None, False), (Var("x"), True), (Var("y"), True)] and (q.limit, q.offset) == (5, 2)


def test_table_function():
    q = parse('SELECT ?x WHERE { ?x <p> ?n . FILTER <http://any/tableFunction>("f", 2, ?n, 3, ?a, ?b) }')
    assert q.where.tables == [TableCall("f", (Var("n"), Term("L", "3", None, XSD + "integer")), (Var("a"), Var("b")))]


@pytest.mark.parametrize(
    "text",
    ["", "SELECT WHERE { ?x <p> ?y }", "SELECT ?x WHERE { ?x <p> ?y", "SELECT ?x WHERE { ?x <p> }", "SELECT ?x WHERE { ?x q:p ?y }", "SELECT ?x WHERE { ?x <p> ?y } LIMIT 0", "SELECT ?x WHERE { ?x <p> ?y } ORDER BY", "PREFIX a: <x> PREFIX a: <y> SELECT ?x WHERE { ?x <p> ?y }", "SELECT ?x WHERE { ?x <p> ?y FILTER (bound(1)) }", "SELECT ?x WHERE { ?x <p> ?y FILTER regex(?y) }", "SELECT ?x WHERE { ?x <p> \x01 }", "SELECT ?x WHERE { ?x <p> ?y FILTER ?y }", "ASK { ?x <p> ?y }", "SELECT ?x WHERE { ?x <p> ?y } extra"],
)
def test_faults(text):
    with pytest.raises(SparqlError):
        parse(text)


def test_from_is_refused():
    with pytest.raises(NotImplementedError):
        parse("SELECT ?x FROM <http://g> WHERE { ?x <p> ?y }")
