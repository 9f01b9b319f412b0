"""Patterns, paths and inference on a small plant, and against a naive evaluator on random graphs."""

from __future__ import annotations

import random

import pytest

from tessera.functions.terms import expand
from tessera.graph import Graph
from tessera.operators.inference import added, closed, content
from tessera.plans.query import Path, Query, as_path, step

PLANT = [
    ("ex:plant1", "a", "t:Plant"), ("ex:plant1", "t:feeds", "ex:line1"), ("ex:plant1", "t:feeds", "ex:line2"), ("ex:plant1", "owl:sameAs", "ex:factoryA"),
    ("ex:line1", "a", "t:Line"), ("ex:line1", "t:feeds", "ex:cell1"), ("ex:line2", "a", "t:Line"), ("ex:line2", "t:feeds", "ex:cell2"),
    ("ex:cell1", "a", "t:Cell"), ("ex:cell1", "rdfs:label", '"Cell 1"'), ("ex:cell2", "a", "t:Cell"), ("ex:cell2", "t:feeds", "ex:line2"),
    ("ex:sensor1", "a", "t:HeatSensor"), ("ex:sensor1", "t:pointOf", "ex:cell1"), ("ex:loop1", "t:feeds", "ex:loop1"),
    ("t:HeatSensor", "rdfs:subClassOf", "t:Sensor"), ("t:Sensor", "rdfs:subClassOf", "t:Device"),
    ("t:feeds", "owl:inverseOf", "t:fedBy"), ("t:pointOf", "owl:inverseOf", "t:hasPoint"),
]
FEEDS = step("t:feeds")


@pytest.fixture(scope="module")
def plant(spark):
    g = Graph.of(spark, PLANT)
    return Graph(closed(g.triples, same=False).cache())


def test_inference_counts(spark):
    g = Graph.of(spark, PLANT)
    assert g.triples.count() == 19
    assert closed(g.triples, same=False).count() == 26
    full = closed(g.triples)
    assert full.count() == 32
    assert closed(full).count() == 32


@pytest.mark.parametrize(
    ("where", "select", "rows"),
    [
        ([("?x", "a", "t:Cell")], ["x"], 2),
        ([("ex:plant1", "t:feeds", "?x")], ["x"], 2),
        ([("ex:cell1", "?p", "t:Cell")], ["p"], 1),
        ([("?x", "t:feeds", "?y")], ["x", "y"], 6),
        ([("?x", "t:feeds", "?x")], ["x"], 1),
        ([("ex:plant1", FEEDS / FEEDS, "?x")], ["x"], 2),
        ([("ex:plant1", FEEDS / FEEDS.optional, "?x")], ["x"], 4),
        ([("ex:plant1", "t:feeds+", "?x")], ["x"], 4),
        ([("ex:plant1", "t:feeds*", "?x")], ["x"], 5),
        ([("ex:plant1", FEEDS.star / FEEDS, "?x")], ["x"], 4),
        ([("?x", "t:feeds+", "?y")], ["x", "y"], 10),
        ([("?x", "t:fedBy+", "ex:plant1")], ["x"], 4),
        ([("?s", step("a") / step("rdfs:subClassOf").star, "t:Device")], ["s"], 1),
        ([("?x", "t:feeds", "?y"), ("?y", "t:feeds", "?z")], ["x", "z"], 5),
        ([("?x", "?p", "ex:cell1")], ["x", "p"], 2),
        ([("ex:cell1", "?p", "?o")], ["p", "o"], 4),
        ([("?s", "?p", "?o")], ["s", "p", "o"], 26),
        ([("?x", "rdfs:label", '"Cell 1"')], ["x"], 1),
        ([("?x", "a", "t:Line"), ("?x", "t:feeds", "ex:nosuch")], ["x"], 0),
        ([("?x", "a", "t:Plant"), ("?x", "t:feeds", "?l"), ("?l", "t:feeds", "?y"), ("?y", "a", "t:Cell")], ["x", "y"], 2),
        ([("ex:plant1", "a", "t:Plant"), ("?x", "a", "t:Line")], ["x"], 2),
        ([("ex:plant1", "a", "t:Cell"), ("?x", "a", "t:Line")], ["x"], 0),
        ([("?x", "a", "t:Cell"), ("?y", "a", "t:Line")], ["x", "y"], 4),
        ([("?x", FEEDS | "t:pointOf", "ex:cell1")], ["x"], 2),
    ],
)
def test_plant(plant, where, select, rows):
    assert plant.count(where, select) == rows


def test_unions_and_errors(plant):
    assert plant.count([("?x", "a", "?c")], ["x"], unions=[[[("?x", "a", "t:Cell")], [("?x", "a", "t:Line")]]]) == 4
    with pytest.raises(ValueError, match="in no pattern"):
        plant.select([("?x", "a", "t:Cell")], ["y"])
    with pytest.raises(ValueError, match="plain predicates"):
        plant.construct([("?x", "t:feeds", "?y")], [("?x", "t:feeds+", "?y")], "out")


def test_query_is_plain_data():
    q = Query.of([("?x", FEEDS.plus / "t:a", "?y")], ["x"], ["g"], [[[("?x", "a", "t:B")], [("?y", "a", "t:C")]]])
    assert Query.from_json(q.to_json()) == q
    assert str(q) == "SELECT ?x FROM g WHERE { ?x (t:feeds+/t:a) ?y . { ?x a t:B } UNION { ?y a t:C } }"
    assert as_path("t:a/t:b*") == step("t:a") / step("t:b").star
    assert expand('"5"^^xsd:int', {"xsd": "X#"}) == '"5"^^X#int'


def test_many_graphs_stay_apart(spark):
    a, b = Graph.of(spark, [("a", "p", "b")], "g1"), Graph.of(spark, [("b", "p", "c"), ("a", "p", "b")], "g2")
    g = Graph(a.triples.union(b.triples))
    assert g.count([("?x", "p", "?y"), ("?y", "p", "?z")], ["x", "z"]) == 1
    assert g.count([("a", "p", "?y")], ["y"]) == 2
    assert g.count([("a", "p", "?y")], ["y"], graphs=["g1"]) == 1
    assert g.graphs().count() == 2


def test_literals_with_tags_match_plain_ones(spark):
    g = Graph.of(spark, [("a", "rdfs:label", '"Hall"@en'), ("b", "rdfs:label", '"Hall"^^xsd:string'), ("c", "rdfs:label", "Hall")])
    assert sorted(r.x for r in g.select([("?x", "rdfs:label", '"Hall"')], ["x"]).collect()) == ["a", "b"]
    assert g.count([("?x", "rdfs:label", '"Hall"@en')], ["x"]) == 1


def test_added_and_content(spark):
    g = Graph.of(spark, PLANT)
    whole = closed(g.triples)
    first = g.triples.where("s != 'ex:cell2'")
    grown, changed = Graph(closed(first)).add(g.triples)
    assert changed
    assert sorted(map(tuple, grown.triples.collect())) == sorted(map(tuple, whole.collect()))
    assert content(grown.triples).collect() == content(whole.union(whole)).collect()
    again, changed = added(whole, g.triples)
    assert not changed
    assert again.count() == 0


def _naive(triples: set, path: Path) -> set:
    nodes = {x for s, _, o in triples for x in (s, o)}
    if path.op == "p":
        return {(s, o) for s, p, o in triples if p == path.parts[0]}
    parts = [_naive(triples, x) for x in path.parts]
    if path.op == "|":
        return parts[0] | parts[1]
    if path.op == "/":
        return {(a, d) for a, b in parts[0] for c, d in parts[1] if b == c}
    out = set(parts[0])
    while path.op in "*+":
        more = {(a, d) for a, b in out for c, d in parts[0] if b == c} - out
        if not more:
            break
        out |= more
    return out if path.op == "+" else out | {(n, n) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes, preds = [f"n{i}" for i in range(7)], ["p", "q"]
    rows = {(r.choice(nodes), r.choice(preds), r.choice(nodes)) for _ in range(12)}
    g = Graph.of(spark, sorted(rows))
    p, q = step("p"), step("q")
    for path in (p.plus, (p / q).star, (p | q).plus / q.optional):
        want = _naive(rows, path)
        assert {(x.a, x.b) for x in g.select([("?a", path, "?b")], ["a", "b"]).collect()} == want
        start = r.choice(nodes)
        assert {x.b for x in g.select([(start, path, "?b")], ["b"]).collect()} - {start} == {b for a, b in want if a == start} - {start}
        assert {x.a for x in g.select([("?a", path, start)], ["a"]).collect()} - {start} == {a for a, b in want if b == start} - {start}
    got = {(x.a, x.c) for x in g.select([("?a", "p", "?b"), ("?b", "q", "?c"), ("?a", "?e", "?c")], ["a", "c"]).collect()}
    assert got == {(a, c) for a, x, b in rows if x == "p" for b2, y, c in rows if y == "q" and b2 == b if any((a, e, c) in rows for e in preds)}


def test_empty(spark):
    g = Graph(spark.createDataFrame([], "graph string, s string, p string, o string"))
    assert g.count([("?x", "p+", "?y")], ["x"]) == 0
    assert g.count([("?x", "?p", "?y"), ("?y", "p*", "?z")], ["x", "z"]) == 0
    assert closed(g.triples).count() == 0
    assert list(g.chunks([("?x", "?p", "?y")])) == []


def test_chunks_keep_the_last(spark):
    g = Graph.of(spark, [(f"n{i}", "p", "x") for i in range(11)])
    assert [len(c) for c in g.chunks([("?x", "p", "?y")], ["x"], 4)] == [4, 4, 3]


def test_join_order():
    """A cycle over three predicates is joined from the many-to-many one, along functional ones only."""
    from tessera.operators.match import ordered
    from tessera.plans.query import Pattern

    where = [Pattern.of(x) for x in (("?o", "placedBy", "?c"), ("?c", "inNation", "?n"), ("?s", "inNation", "?n"), ("?o", "shippedBy", "?s"))]
    got = ordered(where, {"placedBy", "inNation"})
    assert str(got[0].p) == "shippedBy"
    assert [(str(p.s), str(p.p)) for p in got[1:]] == [("?o", "placedBy"), ("?c", "inNation"), ("?s", "inNation")]


def test_closure_of_known_pairs(spark):
    from tessera.operators.paths import closure

    r = random.Random(3)
    edges = {(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(16)}
    df = spark.createDataFrame([("g", a, b) for a, b in sorted(edges)], "graph string, s string, o string")
    want = {(x.s, x.o) for x in closure(df).collect()}
    first = closure(df.where("s < 'n3'"))
    more = closure(df, first)
    assert {(x.s, x.o) for x in first.union(more).collect()} == want
    assert more.count() == len(want) - first.count()
    assert closure(df, first.union(more)).count() == 0


def test_constants_reach_the_scan(spark):
    from tessera.sources.tables import Tables

    d = "/root/testdata/sf0.001"
    rows = Tables(spark, d, ["t:inNation", "t:segment"]).rows(s="c:42")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,42)" in plan
    assert "Exchange" not in plan
    assert rows.count() == 2
    assert Tables(spark, d, ["t:inNation"]).rows(s="c:042").count() == 0
    assert Tables(spark, d, ["t:inNation"]).rows(s="c:99999999999999999999").count() == 0
    assert Tables(spark, d, ["t:segment"]).rows(o='"BUILDING"').count() > 0


def test_neighbour_classes(plant):
    got = {(r.p, r.other, r.n) for r in plant.neighbour_classes("t:Line").collect()}
    assert got == {("t:feeds", "t:Cell", 2), ("t:fedBy", "t:Plant", 2), ("t:fedBy", "t:Cell", 1)}


def _reached(edges: set) -> set:
    """Pairs that one or more edges join, by plain Python."""
    out = set(edges)
    while more := {(a, d) for a, b in out for c, d in edges if b == c} - out:
        out |= more
    return out


def test_closure_finds_few_pairs_twice(spark, monkeypatch):
    """Chains, cycles and sources: each pair once, and joins that make about as many rows as there are pairs."""
    from tessera.operators import paths

    made = []

    def counted(a, b, plain=paths._joined):
        out = plain(a, b).cache()
        made.append(out.count())
        return out

    monkeypatch.setattr(paths, "_joined", counted)
    random.seed(5)
    tree = {(f"n{i}", f"n{i // 2}") for i in range(1, 200)}
    cycle = {(f"c{i}", f"c{i * 7 % 40}") for i in range(120)}
    net = {(f"m{random.randrange(12)}", f"m{random.randrange(12)}") for _ in range(16)} | {("out", "m1"), ("out", "m2")}
    for edges, most in ((tree, 1.1), (cycle, 1.6), (net, 5)):
        made.clear()
        got = [(r.s, r.o) for r in paths.closure(spark.createDataFrame([("g", *e) for e in sorted(edges)], "graph string, s string, o string")).collect()]
        want = _reached(edges)
        assert sorted(got) == sorted(want)
        assert sum(made) <= most * len(want)


def test_closure_of_known_pairs_with_cycles(spark):
    from tessera.operators.paths import closure

    random.seed(6)
    for n in (6, 9, 14):
        edges = sorted({(f"m{random.randrange(n)}", f"m{random.randrange(n)}") for _ in range(2 * n)})
        df = lambda rows: spark.createDataFrame([("g", *e) for e in sorted(rows)], "graph string, s string, o string")
        first = _reached(set(edges[::2]))
        more = [(r.s, r.o) for r in closure(df(edges), df(first)).collect()]
        assert sorted(more) == sorted(_reached(set(edges)) - first)


def test_inference_turns_triples_once(spark, monkeypatch):
    """Of an inverse predicate with one partner, what was turned is not turned back; without rules nothing is joined."""
    from tessera.operators import inference

    made = []
    monkeypatch.setattr(inference, "cut", lambda df, name, plain=inference.cut: made.append(name) or plain(df, name))
    g = Graph.of(spark, [("a", "p", "b"), ("b", "p", '"lit"'), ("p", "owl:inverseOf", "q")])
    more, changed = added(g.triples.limit(0), g.triples)
    assert changed
    assert sorted((r.s, r.p, r.o) for r in more.where("p in ('p', 'q')").collect()) == [("a", "p", "b"), ("b", "p", '"lit"'), ("b", "q", "a")]
    assert made.count("follows") == 1
    made.clear()
    plain = Graph.of(spark, [("a", "p", "b"), ("a", "p", "b")])
    assert added(plain.triples.limit(0), plain.triples)[0].count() == 1
    assert "follows" not in made


def test_inference_over_several_partners(spark):
    """p and r are both inverse to q, so each holds where the other does; chains of rules and equal subjects too."""
    said = [("a", "p", "b"), ("p", "owl:inverseOf", "q"), ("r", "owl:inverseOf", "q"), ("c", "w", "d"), ("w", "owl:inverseOf", "w"), ("c", "owl:sameAs", "e"), ("d", "w", '"x"')]
    g = Graph.of(spark, said)
    got = {(r.s, r.p, r.o) for r in closed(g.triples).collect()}
    pairs = {(s, p, o) for s, p, o in got if p in ("p", "q", "r", "w")}
    assert pairs == {("a", "p", "b"), ("b", "q", "a"), ("a", "r", "b"), ("c", "w", "d"), ("d", "w", "c"), ("e", "w", "d"), ("d", "w", "e"), ("d", "w", '"x"')}


def test_functional_chains_are_joined_first(spark):
    """Predicates that lead on from each other are joined before the many rows of a pattern without constants."""
    from tessera.operators.match import _chains
    from tessera.plans.query import Pattern

    where = [Pattern.of(x) for x in (("?o", "shippedBy", "?s"), ("?o", "placedBy", "?c"), ("?c", "inNation", "?n"), ("?s", "inNation", "?n"))]
    kinds = lambda ps: [[str(p.p) for p in c] for c in _chains(ps, {"placedBy", "inNation"})]
    assert kinds(where) == [["shippedBy"], ["placedBy", "inNation"], ["inNation"]]
    assert kinds([*where[:2], Pattern.of(("?c", "inNation", "n:1"))]) == [["shippedBy"], ["placedBy"], ["inNation"]]
    assert kinds([where[0], Pattern.of(("?o", "inNation", "?o")), Pattern.of(("?o", "placedBy", "?c"))]) == [["shippedBy"], ["inNation"], ["placedBy"]]


def test_pairs_are_distinct_before_their_terms(spark):
    from tessera.sources.tables import Tables

    rows = Tables(spark, "/root/testdata/sf0.001", ["t:shippedBy", "t:placedBy"]).rows()
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Aggregate")
    assert rows.count() == rows.distinct().count()
