"""The registered queries over the given tables, each with its SQL.

A query maps the tables that it needs to triples and asks a pattern of them. Terms are built by the same
concatenations in the SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.shared import shared_dir
from .functions.terms import INVERSE, LABEL, SAME, SUBCLASS, TYPE
from .graph import Graph
from .operators.inference import added, closed, content
from .operators.match import build_patterns
from .operators.resolve import bits, explode_triples, longest_prefix, prefix_table, resolve_entities
from .plans.query import Query, step
from .sources import lines, turtle
from .sources.store import Bundle, Store, read_rdf
from .sources.tables import Tables, triples
from .streaming import views

QueryFn = Callable[[SparkSession, str], DataFrame]
_DONE: dict[str, tuple[QueryFn, str]] = {}


def _graph(spark: SparkSession, d: str, *predicates: str, graph=None) -> Graph:
    return Graph(Tables(spark, d, list(predicates), graph))


def _add(name: str, predicates: list[str], where, select, sql: str, **more) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _graph(spark, d, *predicates).select(where, select, **more)

    query.__name__ = name
    _DONE[name] = (query, sql)


def _register(sql: str):
    def keep(f: QueryFn) -> QueryFn:
        _DONE[f.__name__] = (f, sql)
        return f

    return keep


# SQL for the mapped pairs, by predicate.
_E = {
    "type": "SELECT 'c:' || c_custkey AS s, 't:Customer' AS o FROM customer UNION SELECT 's:' || s_suppkey, 't:Supplier' FROM supplier UNION SELECT 'n:' || n_nationkey, 't:Nation' FROM nation UNION SELECT 'r:' || r_regionkey, 't:Region' FROM region",
    "inNation": "SELECT 'c:' || c_custkey AS s, 'n:' || c_nationkey AS o FROM customer UNION SELECT 's:' || s_suppkey, 'n:' || s_nationkey FROM supplier",
    "inRegion": "SELECT 'n:' || n_nationkey AS s, 'r:' || n_regionkey AS o FROM nation",
    "label": "SELECT 'n:' || n_nationkey AS s, '\"' || n_name || '\"' AS o FROM nation UNION SELECT 'r:' || r_regionkey, '\"' || r_name || '\"' FROM region",
    "placedBy": "SELECT 'o:' || o_orderkey AS s, 'c:' || o_custkey AS o FROM orders",
    "contains": "SELECT DISTINCT 'o:' || l_orderkey AS s, 'p:' || l_partkey AS o FROM lineitem",
    "shippedBy": "SELECT DISTINCT 'o:' || l_orderkey AS s, 's:' || l_suppkey AS o FROM lineitem",
    "segment": "SELECT 'c:' || c_custkey AS s, '\"' || c_mktsegment || '\"' AS o FROM customer",
    "refers": "SELECT 'c:' || c_custkey AS s, 'c:' || (c_custkey * 7 % 1000) AS o FROM customer",
    "childOf": "SELECT 'p:' || p_partkey AS s, 'p:' || (p_partkey // 2) AS o FROM part WHERE p_partkey > 0",
    "parttype": "SELECT 'p:' || p_partkey AS s, 't:' || replace(p_type, ' ', '_') AS o FROM part",
}
_ALL = " UNION ".join(f"SELECT s, '{p}' AS p, o FROM ({_E[k]})" for k, p in (("inNation", "t:inNation"), ("inRegion", "t:inRegion"), ("label", LABEL)))
_ALL_NAMES = ["t:inNation", "t:inRegion", LABEL]

# Triple patterns.
_add("o1_resolve_subject", ["t:inNation"], [("?c", "t:inNation", "n:7")], ["c"], f"SELECT DISTINCT s AS c FROM ({_E['inNation']}) WHERE o = 'n:7'")
_add("o2_resolve_object", ["t:inNation"], [("c:42", "t:inNation", "?n")], ["n"], f"SELECT DISTINCT o AS n FROM ({_E['inNation']}) WHERE s = 'c:42'")
_add("o3_resolve_predicate", _ALL_NAMES, [("n:7", "?p", "?r"), ("n:3", "?p", "r:3")], ["p"], f"SELECT DISTINCT a.p FROM ({_ALL}) a JOIN ({_ALL}) b ON a.p = b.p WHERE a.s = 'n:7' AND b.s = 'n:3' AND b.o = 'r:3'")
_add("o4_predicate_pairs", ["t:placedBy"], [("?s", "t:placedBy", "?c")], ["s", "c"], f"SELECT s, o AS c FROM ({_E['placedBy']})")
_add(
    "o5_subjects_of_bound", ["t:inNation", "t:inRegion", LABEL], [("?r", LABEL, '"ASIA"'), ("?n", "t:inRegion", "?r"), ("?c", "t:inNation", "?n")], ["c", "n"],
    f"SELECT DISTINCT c.s AS c, n.s AS n FROM ({_E['label']}) l JOIN ({_E['inRegion']}) n ON n.o = l.s JOIN ({_E['inNation']}) c ON c.o = n.s WHERE l.o = '\"ASIA\"'",
)
_add("o6_objects_of_bound", ["t:inNation", "t:inRegion"], [("c:42", "t:inNation", "?n"), ("?n", "t:inRegion", "?r")], ["n", "r"], f"SELECT DISTINCT c.o AS n, n.o AS r FROM ({_E['inNation']}) c JOIN ({_E['inRegion']}) n ON c.o = n.s WHERE c.s = 'c:42'")
_add("o8_in_edges", _ALL_NAMES, [("?s", "?p", "n:3")], ["s", "p"], f"SELECT DISTINCT s, p FROM ({_ALL}) WHERE o = 'n:3'")
_add("o9_out_edges", _ALL_NAMES, [("n:3", "?p", "?o")], ["p", "o"], f"SELECT DISTINCT p, o FROM ({_ALL}) WHERE s = 'n:3'")
_add("o10_expand_subject", _ALL_NAMES, [("?s", "t:inRegion", "r:2"), ("?s", "?p", "?o")], ["s", "p", "o"], f"SELECT DISTINCT s, p, o FROM ({_ALL}) WHERE s IN (SELECT s FROM ({_E['inRegion']}) WHERE o = 'r:2')")
_add("o11_expand_object", _ALL_NAMES, [("?o", "t:inRegion", "r:2"), ("?s", "?p", "?o")], ["s", "p", "o"], f"SELECT DISTINCT s, p, o FROM ({_ALL}) WHERE o IN (SELECT s FROM ({_E['inRegion']}) WHERE o = 'r:2')")
_add("o12_expand_predicate", _ALL_NAMES, [("n:3", "?p", "r:3"), ("?s", "?p", "?o")], ["s", "p", "o"], f"SELECT DISTINCT s, p, o FROM ({_ALL}) WHERE p IN (SELECT p FROM ({_ALL}) WHERE s = 'n:3' AND o = 'r:3')")
_add("o13_full_scan", _ALL_NAMES, [("?s", "?p", "?o")], ["s", "p", "o"], f"SELECT DISTINCT s, p, o FROM ({_ALL})")
_add("o14_ground_guard", ["t:inRegion", "t:inNation"], [("n:3", "t:inRegion", "r:3"), ("?c", "t:inNation", "n:3")], ["c"], f"SELECT DISTINCT s AS c FROM ({_E['inNation']}) WHERE o = 'n:3' AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3)")
_add("j4_self_loop", ["t:refers"], [("?x", "t:refers", "?x")], ["x"], f"SELECT DISTINCT s AS x FROM ({_E['refers']}) WHERE s = o")
_add("j1_cycle_of_three", ["t:placedBy", "t:inNation", "t:shippedBy"], [("?o", "t:placedBy", "?c"), ("?c", "t:inNation", "?n"), ("?s", "t:inNation", "?n"), ("?o", "t:shippedBy", "?s")], ["o", "s"], "SELECT DISTINCT 'o:' || o_orderkey AS o, 's:' || s_suppkey AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey")
_add("j6_product", ["t:inNation", "t:placedBy"], [("?a", "t:inNation", "n:1"), ("?b", "t:placedBy", "c:3")], ["a", "b"], f"SELECT DISTINCT a.s AS a, b.s AS b FROM ({_E['inNation']}) a, ({_E['placedBy']}) b WHERE a.o = 'n:1' AND b.o = 'c:3'")
_add("q2_select_all", ["t:placedBy", "t:segment", "t:status"], [("?o", "t:placedBy", "?c"), ("?c", "t:segment", "?g"), ("?o", "t:status", '"F"')], (), f"SELECT p.s AS o, p.o AS c, g.o AS g FROM ({_E['placedBy']}) p JOIN ({_E['segment']}) g ON p.o = g.s WHERE p.s IN (SELECT 'o:' || o_orderkey FROM orders WHERE o_orderstatus = 'F')")

# Paths.
_add("p3_sequence", ["t:placedBy", "t:inNation", "t:inRegion"], [("?o", "t:placedBy/t:inNation/t:inRegion", "?r")], ["o", "r"], "SELECT DISTINCT 'o:' || o_orderkey AS o, 'r:' || n_regionkey AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_UP = "WITH RECURSIVE up(a) AS ({start} UNION SELECT a // 2 FROM up WHERE a > 0) SELECT DISTINCT 'p:' || a AS a FROM up"
_add("p5_optional_hop", ["t:childOf"], [("p:199", "t:childOf?", "?a")], ["a"], "SELECT 'p:199' AS a UNION SELECT 'p:99' FROM part WHERE p_partkey = 199")
_add("p6_plus_tree", ["t:childOf"], [("p:199", "t:childOf+", "?a")], ["a"], _UP.format(start="SELECT p_partkey // 2 FROM part WHERE p_partkey = 199"))
_add("p7_star_tree", ["t:childOf"], [("p:199", "t:childOf*", "?a")], ["a"], _UP.format(start="SELECT p_partkey FROM part WHERE p_partkey = 199"))
_add("p6_plus_backward", ["t:childOf"], [("?a", "t:childOf+", "p:3")], ["a"], "WITH RECURSIVE down(a) AS (SELECT p_partkey FROM part WHERE p_partkey // 2 = 3 AND p_partkey > 0 UNION SELECT p_partkey FROM part, down WHERE p_partkey // 2 = a AND p_partkey > 0) SELECT DISTINCT 'p:' || a AS a FROM down")
_CYCLE = "WITH RECURSIVE b(x, y) AS (SELECT c_custkey, c_custkey * 7 % 1000 FROM customer UNION SELECT x, y * 7 % 1000 FROM b WHERE y IN (SELECT c_custkey FROM customer)) SELECT DISTINCT "
_add("p6_plus_cycle", ["t:refers"], [("c:1", "t:refers+", "?n")], ["n"], _CYCLE + "'c:' || y AS n FROM b WHERE x = 1")
_add("p6_plus_unseeded", ["t:refers"], [("?a", "t:refers+", "?b")], ["a", "b"], _CYCLE + "'c:' || x AS a, 'c:' || y AS b FROM b")
_add("p6_plus_unseeded_tree", ["t:childOf"], [("?a", "t:childOf+", "?b")], ["a", "b"], "WITH RECURSIVE up(a, b) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT a, b // 2 FROM up WHERE b > 0) SELECT DISTINCT 'p:' || a AS a, 'p:' || b AS b FROM up")
_add("p7_star_unseeded", ["t:refers"], [("?a", "t:refers*", "?b")], ["a", "b"], _CYCLE + "'c:' || x AS a, 'c:' || y AS b FROM b UNION SELECT s, s FROM (" + _E["refers"] + ") UNION SELECT o, o FROM (" + _E["refers"] + ")")
_add("p7_typed_subclass", ["part type", SUBCLASS], [("?p", step("a") / step(SUBCLASS).star, "t:Part")], ["p"], "SELECT 'p:' || p_partkey AS p FROM part")
_add("p8_part_of_plus", ["t:partOf"], [("?c", "t:partOf+", "r:3")], ["c"], f"SELECT s AS c FROM ({_E['inRegion']}) WHERE o = 'r:3' UNION SELECT s FROM ({_E['inNation']}) WHERE o IN (SELECT s FROM ({_E['inRegion']}) WHERE o = 'r:3')")
_add("p9_choice", ["t:contains", "t:shippedBy"], [("o:5", step("t:contains") | "t:shippedBy", "?x")], ["x"], f"SELECT o AS x FROM ({_E['contains']}) WHERE s = 'o:5' UNION SELECT o FROM ({_E['shippedBy']}) WHERE s = 'o:5'")

# Sets, graphs and counts.
_add("q12_union", ["t:segment", "t:inNation"], [("?c", "t:inNation", "?n")], ["c", "n"], f"SELECT DISTINCT n.s AS c, n.o AS n FROM ({_E['inNation']}) n WHERE n.o = 'n:3' OR n.s IN (SELECT s FROM ({_E['segment']}) WHERE o = '\"BUILDING\"')", unions=[[[("?c", "t:inNation", "n:3")], [("?c", "t:segment", '"BUILDING"')]]])


@_register(f"SELECT count(*) AS n FROM (SELECT DISTINCT p.o AS c, x.o AS s FROM ({_E['placedBy']}) p JOIN ({_E['shippedBy']}) x ON p.s = x.s)")
def r2_count_distinct(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, "t:placedBy", "t:shippedBy")
    return g.select([("?o", "t:placedBy", "?c"), ("?o", "t:shippedBy", "?s")], ["c", "s"]).agg(F.count("*").alias("n"))



@_register(f"SELECT count(*) AS n FROM ({_E['placedBy']}) p JOIN ({_E['segment']}) g ON p.o = g.s WHERE g.o = '\"BUILDING\"'")
def q3_count(spark: SparkSession, d: str) -> DataFrame:
    n = _graph(spark, d, "t:placedBy", "t:segment").count([("?o", "t:placedBy", "?c"), ("?c", "t:segment", '"BUILDING"')], ["o"])
    return spark.createDataFrame([(n,)], "n long")


def _half() -> Column:
    """Orders in two graphs, by their key."""
    return F.concat(F.lit("g"), F.pmod(F.substring("s", 3, 19).cast("long"), F.lit(2)).cast("string"))


@_register("SELECT DISTINCT 'c:' || o_custkey AS c, CAST(o_orderkey % 2 AS INTEGER) AS g FROM orders")
def u1_multi_graph(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, "t:placedBy", graph=_half())
    parts = [g.select([("?o", "t:placedBy", "?c")], ["c"], graphs=[f"g{i}"]).withColumn("g", F.lit(i)) for i in (0, 1)]
    return parts[0].union(parts[1])


@_register("SELECT DISTINCT 'c:' || o_custkey AS c FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT DISTINCT 'c:' || o_custkey FROM orders WHERE o_orderkey % 2 = 1")
def u1_rows_of_all_graphs(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, "t:placedBy", graph=_half()).select([("?o", "t:placedBy", "?c")], ["c"])


@_register("SELECT DISTINCT 'g' || (o_orderkey % 2) AS graph FROM orders")
def u4_list_graphs(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, "t:placedBy", graph=_half()).graphs()


@_register(f"SELECT o AS p, count(*) AS n FROM (SELECT s, 't:inNation' AS o FROM ({_E['inNation']}) UNION ALL SELECT s, 't:inRegion' FROM ({_E['inRegion']})) GROUP BY o")
def s18_predicate_counts(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, "t:inNation", "t:inRegion").triples.groupBy("p").agg(F.count("*").alias("n"))


# Inference and change.
def _with_rule(spark: SparkSession, t: DataFrame, s: str, p: str, o: str) -> DataFrame:
    return t.union(spark.createDataFrame([("main", s, p, o)], t.schema))


@_register(f"SELECT o AS n, s AS c FROM ({_E['inNation']})")
def i1_inverse(spark: SparkSession, d: str) -> DataFrame:
    t = _with_rule(spark, triples(spark, d, ["t:inNation"]), "t:inNation", INVERSE, "t:nationOf")
    return Graph(closed(t)).select([("?n", "t:nationOf", "?c")], ["n", "c"])


@_register(f"SELECT s, o AS n FROM ({_E['inNation']}) UNION SELECT 's:' || s_suppkey, 'n:' || c_nationkey FROM supplier JOIN customer ON c_custkey = s_suppkey")
def i4_same_as(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d, ["t:inNation"])
    twins = t.where(F.col("s").startswith("c:")).select("s", F.concat(F.lit("s:"), F.substring("s", 3, 20)).alias("o"))
    twins = twins.join(t.select(F.col("s").alias("o")), "o", "left_semi").select(F.lit("main").alias("graph"), "s", F.lit(SAME).alias("p"), "o")
    return Graph(closed(t.union(twins))).select([("?s", "t:inNation", "?n")], ["s", "n"])


@_register(f"SELECT s, o FROM ({_E['inNation']}) WHERE s LIKE 's:%' UNION SELECT o, s FROM ({_E['inNation']}) WHERE s LIKE 's:%'")
def t2_incremental(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d, ["t:inNation"])
    old = closed(_with_rule(spark, t.where(F.col("s").startswith("c:")), "t:inNation", INVERSE, "t:nationOf"))
    more, _ = added(old, t.where(F.col("s").startswith("s:")))
    return more.select("s", "o")


@_register(f"SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(md5(s || chr(9) || 't:placedBy' || chr(9) || o), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM ({_E['placedBy']})")
def r8_content(spark: SparkSession, d: str) -> DataFrame:
    return content(triples(spark, d, ["t:placedBy"])).select("n", "digest")


@_register(f"SELECT c.s, 't:inRegion' AS p, n.o FROM ({_E['inNation']}) c JOIN ({_E['inRegion']}) n ON c.o = n.s UNION SELECT s, 't:nation', o FROM ({_E['inNation']})")
def t4_construct(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d, "t:inNation", "t:inRegion")
    made = g.construct([("?c", "t:inNation", "?n"), ("?n", "t:inRegion", "?r")], [("?c", "t:inRegion", "?r"), ("?c", "t:nation", "?n")], "public")
    return made.select("s", "p", "o")


@_register(f"SELECT 'public' AS graph, o AS s, 't:placed' AS p, s AS o FROM ({_E['placedBy']})")
def q8_into_graph(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, "t:placedBy").construct([("?o", "t:placedBy", "?c")], [("?c", "t:placed", "?o")], "public")


@_register(f"SELECT DISTINCT p FROM ({_ALL}) WHERE s = 'n:3' OR o = 'n:3'")
def s18_predicates_of_node(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, *_ALL_NAMES).predicates("n:3")


@_register(f"SELECT s AS c, o AS n FROM ({_E['inNation']}) WHERE s LIKE 'c:%'")
def a10_sketch(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, TYPE, "t:inNation").select(build_patterns({"c": "t:Customer", "n": "t:Nation"}, [("c", "t:inNation", "n")]), ["c", "n"])


@_register("SELECT 't:placedBy' AS p, 't:Customer' AS other, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def a11_neighbour_classes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d, TYPE, "order type", "t:placedBy", "t:status").neighbour_classes("t:Order")


@_register(f"SELECT s AS c FROM ({_E['segment']}) WHERE o = '\"BUILDING\"'")
def a13_own_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return Graph(Tables(spark, d, ["t:segment"]), {"q": "t:"}).select([("?c", "q:segment", '"BUILDING"')], ["c"])


# Readers and writers: what is written is read back.
_SAID = f"SELECT s, 't:placedBy' AS p, o FROM ({_E['placedBy']}) UNION SELECT 'o:' || o_orderkey, 't:priority', '\"' || o_orderpriority || '\"' FROM orders"
_SAID_NAMES = ["t:placedBy", "t:priority"]


@_register(_SAID)
def s1_turtle(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "ttl")
    turtle.write(triples(spark, d, _SAID_NAMES), path, {"q": "t:"})
    return read_rdf(spark, path, "main", "ttl").select("s", "p", "o")


@_register(_SAID)
def s2_ntriples(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "nt")
    lines.write(triples(spark, d, _SAID_NAMES), path)
    return read_rdf(spark, path, "main", "nt").select("s", "p", "o")


@_register(f"SELECT 'u:g' || (CAST(substr(s, 3) AS BIGINT) % 2) AS graph, s, p, o FROM ({_SAID})")
def s3_nquads(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark, "nq")
    lines.write(triples(spark, d, _SAID_NAMES, F.concat(F.lit("u:"), _half())), path, quads=True)
    return read_rdf(spark, path, "main", "nq")


@_register(f"SELECT s, 'urn:t#placedBy' AS p, o FROM ({_E['placedBy']}) UNION SELECT 'o:' || o_orderkey, 'urn:t#priority', '\"' || o_orderpriority || '\"' FROM orders UNION SELECT 'o:' || o_orderkey, '{TYPE}', 'urn:t#Order' FROM orders")
def s4_rdfxml(spark: SparkSession, d: str) -> DataFrame:
    """Files of a few hundred orders each, written as text and read as RDF/XML."""
    path = shared_dir(spark, "rdf")
    one = F.format_string('<t:Order rdf:about="o:%d"><t:placedBy rdf:resource="c:%d"/><t:priority>%s</t:priority></t:Order>', "o_orderkey", "o_custkey", "o_orderpriority")
    head, tail = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:t="urn:t#">', "</rdf:RDF>"
    files = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.floor(F.col("o_orderkey") / 500).alias("file")).agg(F.concat(F.lit(head), F.array_join(F.collect_list(one), ""), F.lit(tail)).alias("value"))
    files.write.partitionBy("file").text(path)
    return read_rdf(spark, f"{path}/*", "main", "rdf").select("s", "p", "o")


# Stores.
def _store(spark: SparkSession, name: str) -> Store:
    return Store(spark, shared_dir(spark, name))


@_register(f"{_SAID} UNION SELECT o, 't:placed', s FROM ({_E['placedBy']}) UNION SELECT 't:placedBy', '{INVERSE}', 't:placed'")
def s8_load_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Data and a rule in files, loaded into a graph with what follows; a second load changes nothing."""
    path = shared_dir(spark, "bundle")
    lines.write(triples(spark, d, _SAID_NAMES), f"{path}/data.nt")
    rule = spark.createDataFrame([("main", "t:placedBy", INVERSE, "t:placed")], "graph string, s string, p string, o string")
    lines.write(rule, f"{path}/rules.nt")
    store, bundle = _store(spark, "store"), Bundle("orders", (f"{path}/data.nt",), (f"{path}/rules.nt",))
    if not store.load(bundle) or store.load(bundle):
        raise AssertionError("a bundle is loaded once")
    return store.triples("orders").select("s", "p", "o")


@_register(_SAID)
def s21_backup_restore(spark: SparkSession, d: str) -> DataFrame:
    store, path = _store(spark, "store"), shared_dir(spark, "backup")
    store.append(triples(spark, d, _SAID_NAMES))
    store.backup(path)
    return Store.restore(spark, path).triples().select("s", "p", "o")


@_register("SELECT * FROM (VALUES (1, true), (2, false), (3, true)) v(step, changed)")
def t3_changes_reported(spark: SparkSession, d: str) -> DataFrame:
    """Additions of half of the orders, the same half, and all of them, without inference."""
    store, t = _store(spark, "store"), triples(spark, d, ["t:placedBy"])
    half = t.where(F.pmod(F.substring("s", 3, 19).cast("long"), F.lit(2)) == 0)
    said = [store.add(x, infer=False) for x in (half, half, t)]
    if store.triples().count() != t.count():
        raise AssertionError("every triple is stored once")
    return spark.createDataFrame(list(enumerate(said, 1)), "step int, changed boolean")


@_register("WITH RECURSIVE up(a, b) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 0 UNION SELECT a, b // 2 FROM up WHERE b > 0) SELECT DISTINCT 'p:' || a AS a, 'p:' || b AS b FROM up")
def p8_stored_closure(spark: SparkSession, d: str) -> DataFrame:
    """A closure that a store keeps, after edges came in two parts."""
    store, t = _store(spark, "store"), triples(spark, d, ["t:childOf"])
    odd = F.pmod(F.substring("s", 3, 19).cast("long"), F.lit(2)) == 1
    for part in (t.where(odd), t.where(~odd)):
        store.add(part, infer=False)
        got = Graph(store.source("t:childOf")).select([("?a", "t:childOf+", "?b")], ["a", "b"])
    return got


# Streams.
def _streamed(spark: SparkSession, d: str, predicates: list[str]) -> DataFrame:
    path = shared_dir(spark, "arrivals")
    triples(spark, d, predicates).write.parquet(path)
    return spark.readStream.schema("graph string, s string, p string, o string").parquet(path)


@_register("SELECT 'c:' || o_custkey AS s, 't:wants' AS p, '\"' || o_orderpriority || '\"' AS o FROM orders GROUP BY ALL")
def t7_published_view(spark: SparkSession, d: str) -> DataFrame:
    """Streamed triples folded into a store, and a view of them published in a graph of its own."""
    store = _store(spark, "store")
    q = Query.of([("?o", "t:placedBy", "?c"), ("?o", "t:priority", "?p")], ["c", "p"], ["main"])
    view = views.View("wants", q, "public", Query.of([("?c", "t:wants", "?p")]).where)
    views.follow(_streamed(spark, d, _SAID_NAMES), store, shared_dir(spark, "offsets"), [view]).awaitTermination()
    return store.triples("public").select("s", "p", "o")


@_register(_SAID)
def t5_replicated(spark: SparkSession, d: str) -> DataFrame:
    """A graph of one store, followed by another."""
    source, peer = _store(spark, "store"), _store(spark, "peer")
    source.append(triples(spark, d, _SAID_NAMES, F.lit("public")))
    views.subscribe(source, peer, shared_dir(spark, "offsets")).awaitTermination()
    return peer.triples("peer").select("s", "p", "o")


@_register("SELECT 'c:' || o_custkey AS c, count(*) AS n FROM orders GROUP BY ALL")
def t9_continuous_query(spark: SparkSession, d: str) -> DataFrame:
    """The rows of a query that is kept up to date while triples stream in."""
    name = shared_dir(spark, "rows").rsplit("/", 1)[1].replace("-", "_")
    q = Query.of([("?o", "t:placedBy", "?c")])
    views.watch(_streamed(spark, d, ["t:placedBy"]), _store(spark, "store"), q, name, shared_dir(spark, "offsets")).awaitTermination()
    return spark.table(f"global_temp.{name}").groupBy("c").agg(F.count("*").alias("n"))


@_register("SELECT DISTINCT 'u:' || user_id AS s, 't:did' AS p, 'e:' || event_type AS o FROM events")
def t10_record_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream of records, each turned into triples, folded into a store."""
    path, store = shared_dir(spark, "records"), _store(spark, "store")
    events = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    made = explode_triples(stream, "main", (F.concat(F.lit("u:"), F.col("user_id").cast("string")), "t:did", F.concat(F.lit("e:"), "event_type")))
    views.follow(made, store, shared_dir(spark, "offsets")).awaitTermination()
    return store.triples().select("s", "p", "o")


# Records and prefixes.
@_register(
    "WITH k AS (SELECT o_orderkey, o_orderkey || '' || o_custkey AS key FROM orders), c AS (SELECT o_orderkey, unnest(range(1, length(key) + 1)) AS n, key FROM k) "
    "SELECT k.o_orderkey, max_by(p_partkey, n) AS value FROM k LEFT JOIN (SELECT c.o_orderkey, p_partkey, n FROM c JOIN part ON CAST(p_partkey AS VARCHAR) = substr(key, 1, n)) f ON k.o_orderkey = f.o_orderkey GROUP BY k.o_orderkey"
)
def j7_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").cast("string").alias("prefix"), F.col("p_partkey").alias("value"))
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("key"))
    return longest_prefix(rows, "key", table).select("o_orderkey", "value")


_HEX = "lpad(to_hex({0}), 6, '0')"


@_register(
    f"WITH h AS (SELECT p_partkey, {_HEX.format('p_partkey')} AS h FROM part), t AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN substr(h, 1, 5) ELSE h END AS pre, min('P' || p_partkey) AS v FROM h GROUP BY 1), "
    f"a AS (SELECT o_orderkey, {_HEX.format('o_custkey')} AS h FROM orders) SELECT o_orderkey, coalesce(x.v, y.v) AS vendor FROM a LEFT JOIN t x ON x.pre = a.h LEFT JOIN t y ON y.pre = substr(a.h, 1, 5)"
)
def s24_prefix_table(spark: SparkSession, d: str) -> DataFrame:
    """A prefix file written from parts, read, and looked up for addresses made of orders."""
    path = shared_dir(spark, "prefixes")
    six = lambda c: F.lpad(F.hex(c), 6, "0")
    pairs = lambda c: F.concat_ws(":", *[F.substring(six(c), i, 2) for i in (1, 3, 5)])
    line = F.concat(pairs("p_partkey"), F.when(F.col("p_partkey") % 5 == 0, "/20").otherwise(""), F.lit("\tP"), F.col("p_partkey").cast("string"), F.lit("\tthe part # of a list"))
    spark.read.parquet(f"{d}/part.parquet").select(line.alias("value")).write.text(path)
    orders = spark.read.parquet(f"{d}/orders.parquet")
    rows = orders.select("o_orderkey", bits(F.concat(pairs("o_custkey"), F.lit("-"), six("o_orderkey"))).alias("key"))
    return longest_prefix(rows, "key", prefix_table(spark, path), value="short").select("o_orderkey", F.col("short").alias("vendor"))


@_register("SELECT event_id, CASE WHEN event_type < 'p' THEN 'e:' || event_type ELSE 'urn:entity:' || sha256('t:name' || chr(9) || event_type) END AS entity FROM events")
def j6_entities(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    known = explode_triples(events.where("event_type < 'p'"), "main", (F.concat(F.lit("e:"), "event_type"), "t:name", F.concat(F.lit('"'), "event_type", F.lit('"'))))
    return resolve_entities(events, known, "t:name", "event_type").select("event_id", "entity")


@_register("SELECT 'u:' || user_id AS s, 't:did' AS p, 'e:' || event_type AS o FROM events UNION SELECT 'u:' || user_id, 't:saw', '\"' || event_id || '\"' FROM events")
def s23_records_to_triples(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    user = F.concat(F.lit("u:"), F.col("user_id").cast("string"))
    made = explode_triples(e, "main", (user, "t:did", F.concat(F.lit("e:"), "event_type")), (user, "t:saw", F.concat(F.lit('"'), F.col("event_id").cast("string"), F.lit('"'))))
    return made.select("s", "p", "o").distinct()


@_register("SELECT '<o:' || o_orderkey || '> <t:placedBy> <c:' || o_custkey || '> .' AS value FROM orders UNION ALL SELECT '<o:' || o_orderkey || '> <t:priority> \"' || o_orderpriority || '\" .' FROM orders")
def k4_statements(spark: SparkSession, d: str) -> DataFrame:
    return lines.statements(triples(spark, d, _SAID_NAMES))


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in _DONE.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in _DONE.items()}


def entry(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: each customer's and supplier's region, over two hops."""
    return _graph(spark, d, "t:inNation", "t:inRegion").select([("?c", "t:inNation", "?n"), ("?n", "t:inRegion", "?r")], ["c", "r"])
