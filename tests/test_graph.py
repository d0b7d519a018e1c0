import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkseek.errors import NotFound, ParseError, SearchError
from sparkseek.plans import ast as a
from sparkseek.plans import graph as graph_module
from sparkseek.plans.graph import Graph
from sparkseek.plans.parser import Parser, parse

SCHEMA = """
// people and what they work on
define entity person as name: string, age: int, born: date;
define entity project as name: string, cost: double;
define relationship assigned as (project: project, who: person);
define relationship knows as (one: person, two: person);
define relationship colleagues as (one: person, two: person), days: int;
"""
FACTS = """
insert $ann isa person (name: "Ann", age: 40, born: 01-02-1980);
insert $bob isa person (name: "Bob", age: 30, born: 1990-03-04);
insert $cid isa person (name: "Cid", age: 20);
insert $x isa project (name: "X", cost: 10);
insert $y isa project (name: "Y", cost: 2.5);
insert $1 (project: $x, who: $ann) forms assigned;
insert $2 (project: $x, who: $bob) forms assigned;
insert $3 ($y, $cid) forms assigned;
insert $4 (one: $ann, two: $bob) forms knows;
insert $5 (one: $bob, two: $cid) forms knows;
insert $6 (one: $cid, two: $ann) forms knows;
""".replace("$1", "$f1").replace("$2", "$f2").replace("$3", "$f3").replace("$4", "$f4").replace("$5", "$f5").replace("$6", "$f6")


@pytest.fixture()
def g(spark):
    graph = Graph(spark)
    graph.run(SCHEMA + FACTS)
    return graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_definitions_and_insertions_parse():
    entity, relation = parse("define entity city as name: string, big: boolean; define relationship road as (start: city, end: city), km: double;")
    assert entity == a.EntityDefinition("city", (("name", "string"), ("big", "boolean")))
    assert relation == a.RelationDefinition("road", (("start", "city"), ("end", "city")), (("km", "double"),))
    (one,) = parse('insert $b isa city (name: "Bonn", big: false);')
    assert one == a.EntityInsertion("b", "city", (a.Attribute("name", a.Literal("Bonn", "string")), a.Attribute("big", a.Literal(False, "boolean"))))
    (two,) = parse("insert $r (start: $b, $c) forms road (km: 1.5);")
    assert two == a.RelationInsertion("r", (a.Role("start", "b"), a.Role(None, "c")), "road", (a.Attribute("km", a.Literal(1.5, "double")),))


def test_values_parse():
    value = lambda s: Parser(s).expression()
    assert value("11-8-2024") == a.Literal(dt.date(2024, 8, 11), "date") and value("2024-08-11") == a.Literal(dt.date(2024, 8, 11), "date")
    assert value('"a, b"') == a.Literal("a, b", "string") and value('""') == a.Literal("", "string") and value("true") == a.Literal(True, "boolean") and value("$v") == a.Var("v") and value("7") == a.Literal(7, "int")


def test_precedence():
    show = lambda e: e.name if isinstance(e, a.Var) else f"({e.op}{show(e.argument)})" if isinstance(e, a.Unary) else f"({show(e.left)}{e.op}{show(e.right)})"
    for source, want in (
        ("$a + $b * $c", "(a+(b*c))"), ("($a + $b) * $c", "((a+b)*c)"), ("$a - $b - $c", "((a-b)-c)"), ("$a ** $b ** $c", "(a**(b**c))"), ("-$a * $b", "((-a)*b)"),
        ("$a == $b and $c < $d or !$e", "(((a==b)and(c<d))or(!e))"), ("$a or $b and $c", "(aor(bandc))"), ("$a % $b / $c", "((a%b)/c)"),
    ):
        assert show(Parser(source).expression()) == want


def test_queries_and_rules_parse():
    (q,) = parse("match $e isa person (name: $n), ($e, $p) forms assigned, ($x > 3 or $x == 1) and $e != $p compute $y = $x * 2 get $n, $y;")
    assert [type(p) for p in q.patterns] == [a.EntityPattern, a.RelationPattern, a.Condition] and q.get == ("n", "y") and q.computes[0].variable == "y"
    (r,) = parse("define rule far as match (from: $a, to: $b) forms near, not (from: $b) forms near infer materialize (from: $a, to: $b) forms far, $z isa thing (size: 3), extend $a (seen: true);")
    assert r.kind == "materialize" and isinstance(r.patterns[1], a.Negation) and [type(i) for i in r.inferences] == [a.RelationInference, a.EntityInference, a.Extension]
    (d,) = parse("define rule d as match $p isa person compute $k = years_between($b, current_date()) infer derive $p isa old;")
    assert d.computes == (a.Compute("k", a.Call("years_between", (a.Var("b"), a.Call("current_date", ())))),)


@pytest.mark.parametrize("source,line,column", [("match $a isa", 1, 13), ("define\n  thing x as a: int;", 2, 3), ("match $a isa b get $a", 1, 22), ("insert $a isa b (c: 32-13-2020);", 1, 21), ("match ^", 1, 7)])
def test_errors_say_where(source, line, column):
    with pytest.raises(ParseError) as e:
        parse(source)
    assert (e.value.line, e.value.column) == (line, column)


def test_matching(g):
    (pairs,) = g.run("match $a isa person (name: $n), $b isa person (name: $m), $p isa project (name: $pn), ($p, $a) forms assigned, (project: $p, who: $b) forms assigned, $a != $b get $n, $m, $pn;")
    assert rows(pairs) == [("Ann", "Bob", "X"), ("Bob", "Ann", "X")]
    (old,) = g.run('match $a isa person (name: $n, age: $y), $y >= 30 and $n != "Bob" get $n;')
    assert rows(old) == [("Ann",)]
    (one,) = g.run('match $a isa person (name: "Bob", age: $y) get $y;')
    assert rows(one) == [(30,)]
    (self_,) = g.run("match (one: $a, two: $a) forms knows get $a;")
    assert rows(self_) == [], "a variable stands for one thing"
    (none,) = g.run("match $a isa person (name: $n), not (one: $a) forms knows get $n;")
    assert rows(none) == []


def test_computing(g):
    (out,) = g.run("match $p isa project (name: $n, cost: $c) compute $d = -$c ** 2 + 1, $e = $d % 7 get $n, $d, $e;")
    assert rows(out) == [("X", 101.0, 3.0), ("Y", 7.25, 0.25)]
    (ages,) = g.run("match $a isa person (name: $n, born: $b) compute $y = years_between($b, 2000-03-03), $h = date(\"5-6-2001\") get $n, $y, $h;")
    assert rows(ages.where("y is not null")) == [("Ann", 20, dt.date(2001, 6, 5)), ("Bob", 9, dt.date(2001, 6, 5))]
    g.register("shout", lambda c: F.concat(F.upper(c), F.lit("!")))
    (loud,) = g.run("match $p isa project (name: $n) compute $s = shout($n) get $s;")
    assert rows(loud) == [("X!",), ("Y!",)]


def test_recursive_rules_end_on_cycles(g, tmp_path):
    g.run("""define relationship reach as (from: person, to: person);
        define rule direct as match (one: $a, two: $b) forms knows infer materialize (from: $a, to: $b) forms reach;
        define rule further as match (from: $a, to: $b) forms reach, (from: $b, to: $c) forms reach infer materialize (from: $a, to: $c) forms reach;""")
    (out,) = g.run("match (from: $a, to: $b) forms reach get $a, $b;")
    assert rows(out) == sorted((x, y) for x in ("ann", "bob", "cid") for y in ("ann", "bob", "cid"))
    assert g.materialize(f"file://{tmp_path}/m") == ["reach"] and g.spark.read.parquet(f"file://{tmp_path}/m/reach").count() == 9
    g.run('insert $dan isa person (name: "Dan", age: 1); insert $g (one: $cid, two: $dan) forms knows;')
    (more,) = g.run("match (from: $a, to: $b) forms reach get $a, $b;")
    assert more.count() == 12, "rules follow new facts"


def test_inferred_entities_extensions_and_negation(g):
    g.run("""define entity team as label: string, size: int;
        define rule teams as match $p isa project (name: $n), ($p, $w) forms assigned infer derive $t isa team (label: $n);
        define rule senior as match $a isa person (age: $y), $y > 35 infer derive extend $a (senior: true);
        define relationship idle as (who: person, project: project);
        define rule free as match $a isa person, $p isa project, not (project: $p, who: $a) forms assigned infer derive (who: $a, project: $p) forms idle;""")
    assert rows(g.run("match $t isa team (label: $l) get $l;")[0]) == [("X",), ("Y",)]
    assert rows(g.run("match $a isa person (name: $n, senior: true) get $n;")[0]) == [("Ann",)]
    assert rows(g.run("match (who: $a, project: $p) forms idle get $a, $p;")[0]) == [("ann", "y"), ("bob", "y"), ("cid", "x")]


def test_what_is_wrong_is_said(g):
    for source, kind in (
        ("match $a isa nothing get $a;", NotFound), ("match $a isa person (size: $s) get $a;", SearchError), ("match $a isa person get $b;", SearchError), ("match ($a, $b, $c) forms knows get $a;", SearchError),
        ("match (three: $a) forms knows get $a;", SearchError), ("match $a isa person, $z > 1 get $a;", SearchError), ('insert $q isa person (age: "old");', SearchError), ("insert $q isa person (shoe: 3);", SearchError),
        ("define relationship r as (a: nobody);", NotFound), ("match $a isa person compute $b = nofunction($a) get $b;", NotFound),
    ):
        with pytest.raises(kind):
            g.run(source)
    h = Graph(g.spark)
    h.run(SCHEMA + "define rule r as match $a isa person, not (one: $a, two: $a) forms knows infer derive (one: $a, two: $a) forms knows;")
    with pytest.raises(SearchError, match="negation"):
        h.run("match (one: $a, two: $b) forms knows get $a;")


def test_roles_must_be_held_by_entities_of_their_type(spark):
    g = Graph(spark)
    g.run("define entity person as name: string; define entity town as name: string; define relationship lives as (who: person, place: town);")
    g.add_entities("person", spark.createDataFrame([("p1", "A")], "eid string, name string"))
    g.add_entities("town", spark.createDataFrame([("t1", "T")], "eid string, name string"))
    good = spark.createDataFrame([("r1", "p1", "t1")], "rid string, who string, place string")
    bad = spark.createDataFrame([("r2", "t1", "t1"), ("r3", "p1", "p1")], "rid string, who string, place string")
    g.add_relations("lives", good, check=True)
    with pytest.raises(SearchError):
        g.add_relations("lives", bad, check=True)
    assert g.violations("lives").count() == 0
    assert {tuple(r) for r in g.violations("lives", bad).collect()} == {("who", "t1"), ("place", "p1")}


def test_long_chains_are_compacted_now_and_then(spark, monkeypatch):
    monkeypatch.setattr(graph_module, "COMPACT", 2)
    g = Graph(spark)
    g.run("define entity node as name: string; define relationship step as (source: node, target: node); define relationship reach as (source: node, target: node);")
    g.add_relations("step", spark.createDataFrame([(f"r{i}", f"n{i}", f"n{i + 1}") for i in range(6)], "rid string, source string, target string"))
    g.run("define rule one as match (source: $a, target: $b) forms step infer derive (source: $a, target: $b) forms reach; define rule two as match (source: $a, target: $b) forms reach, (source: $b, target: $c) forms step infer derive (source: $a, target: $c) forms reach;")
    assert g.run("match (source: $a, target: $b) forms reach get $a, $b;")[0].count() == 21
