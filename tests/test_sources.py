"""Readers and writers, the store, record joins and streaming views."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.terms import RDF, TYPE, XSD
from tessera.graph import Graph
from tessera.operators.resolve import dict_triples, longest_prefix, resolve_entities
from tessera.plans.query import Query
from tessera.sources import lines, turtle
from tessera.sources.store import Bundle, Store, read_rdf
from tessera.streaming.views import View, follow, subscribe

TTL = r'''@prefix ex: <http://x/> .
PREFIX t: <http://t#>
@base <http://base/dir/> .
# a comment
ex:a a t:Thing ; t:name "A \"quoted\" é"@en , 'single' ; t:size 5 , 1.5 , 2e3 ; t:on true ;
  t:long """two
lines""" ; .
<rel> t:list ( ex:b "c" ) ; t:inner [ t:x ex:y ; t:z _:n ] .
_:n t:typed "7"^^<http://www.w3.org/2001/XMLSchema#int> .
[ t:only ex:b ] .
() t:nil ex:b .
'''


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def _rows(df):
    return sorted((r.s, r.p, r.o) for r in df.collect())


def test_turtle(spark, tmp_path):
    rows = _rows(turtle.read(spark, _write(tmp_path / "a.ttl", TTL), "g"))
    t = "http://t#"
    assert ("http://x/a", TYPE, t + "Thing") in rows
    assert ("http://x/a", t + "name", '"A "quoted" é"@en') in rows
    assert ("http://x/a", t + "size", f'"2e3"^^{XSD}double') in rows
    assert ("http://x/a", t + "size", f'"1.5"^^{XSD}decimal') in rows
    assert ("http://x/a", t + "on", f'"true"^^{XSD}boolean') in rows
    assert ("http://x/a", t + "long", '"two\nlines"') in rows
    assert any(s == "http://base/dir/rel" for s, _, _ in rows)
    assert (RDF + "nil", t + "nil", "http://x/b") in rows
    assert sum(p == RDF + "first" for _, p, _ in rows) == 2
    assert len(rows) == 19


@pytest.mark.parametrize("text", ["<a> <b> <c>", "ex:a <http://b> <http://c> .", '<http://a> <http://b> "open .', "<http://a b> <http://b> <http://c> .", '"x" <http://b> <http://c> .'])
def test_bad_turtle(spark, tmp_path, text):
    with pytest.raises(Exception, match="line 1|within a statement|unknown prefix"):
        turtle.read(spark, _write(tmp_path / "bad.ttl", text), "g").collect()


def test_lines_round_trip(spark, tmp_path):
    text = '<http://a> <http://p> "x\\t\\u00e9 \\"q\\""@en .\n# note\n\n_:b <http://p> <http://c> <http://g> .\n<http://a> <http://p> "5"^^<http://int> . # end\n'
    df = lines.read(spark, _write(tmp_path / "a.nq", text))
    got = {(r.graph, r.o) for r in df.collect()}
    assert (lines.DEFAULT, '"x\té "q""@en') in got
    assert ("http://g", "http://c") in got
    assert (lines.DEFAULT, '"5"^^http://int') in got
    lines.write(df.where("graph != 'http://g'"), f"file://{tmp_path}/out.nt")
    again = lines.read(spark, f"file://{tmp_path}/out.nt")
    assert _rows(again) == _rows(df.where("graph != 'http://g'"))
    for bad in ("<http://a> <http://p> .", '"lit" <http://p> <http://c> .', "<rel> <http://p> <http://c> ."):
        with pytest.raises(Exception, match="not a statement"):
            lines.read(spark, _write(tmp_path / "bad.nt", bad)).collect()


def test_turtle_round_trip(spark, tmp_path):
    df = turtle.read(spark, _write(tmp_path / "a.ttl", TTL), "g").where("s not like '\\\\_:%' and o not like '\\\\_:%'")
    turtle.write(df, f"file://{tmp_path}/out", {"t": "http://t#", "ex": "http://x/"})
    assert _rows(turtle.read(spark, f"file://{tmp_path}/out", "g")) == _rows(df)


def test_rdfxml(spark, tmp_path):
    text = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:t="http://t#" xml:base="http://b/">
      <t:Thing rdf:about="a" t:attr="v" xml:lang="en">
        <t:to rdf:resource="#c"/><t:name>N</t:name><t:n rdf:datatype="http://int">5</t:n>
        <t:sub rdf:parseType="Resource"><t:x>1</t:x></t:sub>
        <t:all rdf:parseType="Collection"><rdf:Description rdf:about="d"/><t:Thing rdf:about="e"/></t:all>
        <t:bag><rdf:Bag><rdf:li>one</rdf:li><rdf:li>two</rdf:li></rdf:Bag></t:bag>
        <t:said rdf:ID="r">yes</t:said>
        <t:xml rdf:parseType="Literal">x<b>y</b></t:xml>
      </t:Thing></rdf:RDF>"""
    rows = _rows(read_rdf(spark, _write(tmp_path / "a.rdf", text), "g"))
    a = "http://b/a"
    for t in [(a, TYPE, "http://t#Thing"), (a, "http://t#attr", '"v"@en'), (a, "http://t#to", "http://b/#c"), (a, "http://t#n", '"5"^^http://int'), ("http://b/#r", RDF + "subject", a), ("http://b/e", TYPE, "http://t#Thing")]:
        assert t in rows
    assert sum(p in (RDF + "_1", RDF + "_2") for _, p, _ in rows) == 2
    assert sum(p == RDF + "first" for _, p, _ in rows) == 2


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    a = _write(tmp_path / "a.ttl", "@prefix t: <http://t#> . @prefix owl: <http://www.w3.org/2002/07/owl#> . <http://a> t:p <http://b> . t:p owl:inverseOf t:q .")
    bundle = Bundle("g", (a,))
    assert store.load(bundle)
    assert not store.load(bundle)
    assert store.prefixes("g")["t"] == "http://t#"
    assert store.triples("g").count() == 3
    _write(tmp_path / "a.ttl", "@prefix t: <http://t#> . <http://a> t:p <http://c> .")
    assert store.load(bundle)
    assert store.triples("g").count() == 5
    assert Graph(store.triples()).count([("?x", "http://t#q", "http://a")], ["x"]) == 2
    store.backup(f"file://{tmp_path}/copy")
    assert Store.restore(spark, f"file://{tmp_path}/copy").triples().count() == 5


def test_records(spark):
    rows = spark.createDataFrame([("aa:bb:cc",), ("aa:bx",), ("zz",), (None,)], "mac string")
    table = spark.createDataFrame([("aa", "A"), ("aa:bb", "B")], "prefix string, value string")
    assert {r.mac: r.value for r in longest_prefix(rows, "mac", table).collect()} == {"aa:bb:cc": "B", "aa:bx": "A", "zz": None, None: None}
    known = Graph.of(spark, [("e:1", "t:mac", '"zz"')]).triples
    got = {r.mac: r.entity for r in resolve_entities(rows, known, "t:mac", "mac").collect()}
    assert got["zz"] == "e:1"
    assert got["aa:bx"].startswith("urn:entity:")
    assert dict_triples({"a": {"p": ["x", {"b": {"q": "y"}}]}}) == [("a", "p", "x"), ("a", "p", "b"), ("b", "q", "y")]


def test_two_hops_of_views(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    one, two, three = Store(spark, at("one")), Store(spark, at("two")), Store(spark, at("three"))
    rooms = View("rooms", Query.of([("?x", "a", "t:Room")], ["x"], ["main"]))
    passed = View("passed", Query.of([("?x", "a", "t:Room")], ["x"], ["peer"]))
    feed = at("feed")
    Graph.of(spark, [("r1", "a", "t:Room"), ("s1", "a", "t:Sensor")]).triples.write.mode("append").parquet(feed)

    def turn():
        stream = spark.readStream.schema("graph string, s string, p string, o string").parquet(feed)
        follow(stream, one, at("c1"), [rooms]).awaitTermination()
        subscribe(one, two, at("c2"), views=[passed]).awaitTermination()
        subscribe(two, three, at("c3")).awaitTermination()

    turn()
    assert three.triples("peer").count() == 1
    Graph.of(spark, [("r2", "a", "t:Room")]).triples.write.mode("append").parquet(feed)
    turn()
    turn()
    assert sorted(r.s for r in three.triples("peer").collect()) == ["r1", "r2"]
    assert one.triples("main").count() == 3


def test_markup_in_literals(spark, tmp_path):
    text = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e#"><rdf:Description rdf:about="urn:a"><e:says rdf:parseType="Literal">a &lt; b <e:i>x &amp; y</e:i> end</e:says></rdf:Description></rdf:RDF>'
    (tmp_path / "a.rdf").write_text(text)
    o = read_rdf(spark, f"file://{tmp_path}/a.rdf", "g").first().o
    assert o.startswith('"a &lt; b <e:i ')
    assert o.endswith('>x &amp; y</e:i> end"^^http://www.w3.org/1999/02/22-rdf-syntax-ns#XMLLiteral')


def test_prefix_table(spark, tmp_path):
    from tessera.operators.resolve import bits, longest_prefix, prefix_table

    lines = ["# vendors", "", "00:00:0C\tAbc\tAbc Works # the first", "00-1B-C5-00-00-00/36\tDef", "001BC5\tGhi\tGhi Ltd", "no name here", "00:1B:C5:00:10:00/36\tJkl # note", "70B3D5/0x\tbad length"]
    (tmp_path / "p.txt").write_text("\n".join(lines))
    table = prefix_table(spark, f"file://{tmp_path}/p.txt")
    assert {(len(r.prefix), r.short, r.long) for r in table.where("short != 'bad length'").collect()} == {(24, "Abc", "Abc Works"), (36, "Def", None), (24, "Ghi", "Ghi Ltd"), (36, "Jkl", None)}
    rows = spark.createDataFrame([("00:00:0c:01:02:03",), ("001bc5000abc",), ("001bc5001abc",), ("001bc5ffffff",), ("ffffffffffff",), ("",)], "mac string")
    got = longest_prefix(rows.select("mac", bits(F.col("mac")).alias("key")), "key", table, value="short")
    assert {r.mac: r.short for r in got.collect()} == {"00:00:0c:01:02:03": "Abc", "001bc5000abc": "Def", "001bc5001abc": "Jkl", "001bc5ffffff": "Ghi", "ffffffffffff": None, "": None}


def test_lines_are_matched_once(spark, tmp_path):
    """Every group of a statement comes from one pass, and terms of many characters need no deep stack."""
    long = "x" * 20000
    said = [
        f'<s:a> <p:b> "{long}" .',
        f"<s:{long}> <p:b> <o:c> <g:d> .",
        '_:a <p:b> "say \\"hi\\"\\n"@en-GB _:g . # end',
        '<s:a><p:b>"5"^^<x:int>.',
        "  ",
        "<s:a> <p:b> _:c.d .",
    ]
    (tmp_path / "long.nq").write_text("\n".join(said))
    df = lines.read(spark, f"file://{tmp_path}/long.nq", "main")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert "regexp_extract(" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.graph if r.graph[0] != "_" else r.graph[-2:], r.s if r.s[0] != "_" else r.s[-2:], r.o if r.o[0] != "_" else r.o[-4:]) for r in df.collect()}
    assert got == {("main", "s:a", f'"{long}"'), ("g:d", f"s:{long}", "o:c"), ("-g", "-a", '"say "hi"\n"@en-GB'), ("main", "s:a", '"5"^^x:int'), ("main", "s:a", "-c.d")}


def test_longest_prefix_sends_the_short_ones(spark, monkeypatch):
    """Short prefixes are joined where the keys are, long ones by shuffle; a task has a bounded share of the rows."""
    from tessera.operators import resolve

    monkeypatch.setattr(resolve, "SENT", 4)
    monkeypatch.setattr(resolve, "ROWS", 20)
    table = ["", "1", "2", "12", "123", "1234", "77", "777", "é", "1é"]
    keys = [str(i) for i in range(0, 2000, 7)] + ["1", "1", "1234567", "77", "7777", "", "éa", "1éa", None]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, key string")
    got = longest_prefix(rows, "key", spark.createDataFrame([(p, "v" + p) for p in table], "prefix string, value string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    tasks = -(-len(keys) // 20)
    assert f", {tasks}" in plan
    want = {i: max((p for p in table if p and k is not None and k.startswith(p)), key=len, default=None) for i, k in enumerate(keys)}
    assert {r.id: r.value for r in got.collect()} == {i: p and "v" + p for i, p in want.items()}
    assert got.count() == len(keys)
