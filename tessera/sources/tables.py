"""Relational tables as triples: each predicate is a projection of one or several tables.

A term of a table is made of a kind and a key column (``c:42``), of a text column (a literal), or is fixed.
Only the tables and columns of the predicates that a query uses are scanned, and a constant is turned into a
condition on its key column, so that it reaches the Parquet scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.terms import LABEL, SUBCLASS, TYPE, literal
from ..operators.paths import union


@dataclass(frozen=True)
class Term:
    """One end of a mapping: ``kind`` and integer ``key`` column, a literal of a ``text`` column, or any column."""

    kind: str = ""
    key: str = ""
    text: str = ""
    column: Column | None = None

    def cell(self) -> Column:
        """What the table has for the term: a key, a text or the term itself. Different cells are different terms."""
        return F.expr(self.key) if self.kind else F.col(self.text) if self.text else self.column  # type: ignore[return-value]

    def made(self, cell: Column | None = None) -> Column:
        cell = self.cell() if cell is None else cell
        return F.concat(F.lit(self.kind + ":"), cell.cast("string")) if self.kind else literal(cell) if self.text else cell

    def meets(self, term: str) -> Column | None:
        """The condition for being ``term``, on the table's own columns where it can be; None if it never is."""
        if self.kind:
            key = re.fullmatch(re.escape(self.kind) + r":(0|-?[1-9][0-9]*)", term)
            # Numbers beyond a long are no key.
            return F.expr(self.key) == F.lit(int(key[1])) if key and abs(int(key[1])) < 2**63 else None
        if self.text:
            plain = re.fullmatch(r'(?s)"(.*)"', term)
            # The column's own text can't be read as one with a language or datatype.
            return F.col(self.text) == plain[1] if plain and plain[1].count('"') == 0 else terms.matches(self.made(), term)
        return terms.matches(self.made(), term)


@dataclass(frozen=True)
class Mapping:
    """Pairs of a predicate: a table, its two ends, and whether its subjects are unique."""

    table: str
    s: Term
    o: Term
    unique: bool = True
    where: str = "true"

    def read(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.table == "next":
            w = Window.partitionBy("user_id").orderBy("ts", "event_id")
            return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.lead("event_type").over(w).alias("then")).where("then is not null")
        return spark.read.parquet(f"{sf_dir}/{self.table}.parquet").where(self.where)


def sources() -> dict[str, list[Mapping]]:
    """Where the pairs of each predicate come from. ``part type`` and ``order type`` are rdf:type of those tables."""
    fixed = lambda name: Term(column=F.lit("t:" + name))
    part_kind = Term(column=F.concat(F.lit("t:"), F.replace("p_type", F.lit(" "), F.lit("_"))))
    c, s, n, r, o, p = (Term(*x) for x in (("c", "c_custkey"), ("s", "s_suppkey"), ("n", "n_nationkey"), ("r", "r_regionkey"), ("o", "o_orderkey"), ("p", "p_partkey")))
    in_region = Mapping("nation", n, Term("r", "n_regionkey"))
    in_nation = [Mapping("customer", c, Term("n", "c_nationkey")), Mapping("supplier", s, Term("n", "s_nationkey"))]
    event = Term(column=F.concat(F.lit("e:"), "event_type"))
    return {
        TYPE: [Mapping("customer", c, fixed("Customer")), Mapping("supplier", s, fixed("Supplier")), Mapping("nation", n, fixed("Nation")), Mapping("region", r, fixed("Region"))],
        "part type": [Mapping("part", p, part_kind)],
        "order type": [Mapping("orders", o, fixed("Order"))],
        SUBCLASS: [Mapping("part", part_kind, fixed("Part"), unique=False)],
        LABEL: [Mapping("nation", n, Term(text="n_name")), Mapping("region", r, Term(text="r_name"))],
        "t:inNation": in_nation,
        "t:inRegion": [in_region],
        "t:partOf": [*in_nation, in_region],
        "t:segment": [Mapping("customer", c, Term(text="c_mktsegment"))],
        "t:placedBy": [Mapping("orders", o, Term("c", "o_custkey"))],
        "t:status": [Mapping("orders", o, Term(text="o_orderstatus"))],
        "t:priority": [Mapping("orders", o, Term(text="o_orderpriority"))],
        "t:contains": [Mapping("lineitem", Term("o", "l_orderkey"), Term("p", "l_partkey"), unique=False)],
        "t:shippedBy": [Mapping("lineitem", Term("o", "l_orderkey"), Term("s", "l_suppkey"), unique=False)],
        "t:brand": [Mapping("part", p, Term(text="p_brand"))],
        "t:childOf": [Mapping("part", p, Term("p", "p_partkey div 2"), where="p_partkey > 0")],
        "t:refers": [Mapping("customer", c, Term("c", "c_custkey * 7 % 1000"))],
        "t:did": [Mapping("events", Term("u", "user_id"), event, unique=False)],
        "t:next": [Mapping("next", event, Term(column=F.concat(F.lit("e:"), "then")), unique=False)],
    }


class Tables:
    """The triples of some predicates of the tables in a folder; asked for by constants like any triples.

    ``graph`` is an expression over s, p and o (default: all rows are in the graph ``main``).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, predicates: list[str], graph: Column | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.graph = F.lit("main") if graph is None else graph
        known = sources()
        self.mappings = [(TYPE if name.endswith(" type") else name, m) for name in predicates for m in known[name]]
        by_name: dict[str, list[Mapping]] = {}
        for name, m in self.mappings:
            by_name.setdefault(name, []).append(m)
        #: Predicates with a single mapping: they share no pair with another.
        self.sole = {name: len(ms) == 1 for name, ms in by_name.items()}
        #: Predicates of which a subject has one object.
        self.functional = {name for name, ms in by_name.items() if all(m.unique for m in ms) and len({m.s.kind for m in ms}) == len(ms)}

    def rows(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """(graph, s, p, o), each once, of the triples with these constants."""
        parts, repeated = [], False
        for name, m in self.mappings:
            conditions = [end.meets(term) for end, term in ((m.s, s), (m.o, o)) if term is not None]
            if p not in (None, name) or any(x is None for x in conditions):
                continue
            t = m.read(self.spark, self.sf_dir)
            for x in conditions:
                t = t.where(x)
            if name not in self.functional and self.sole[name]:
                # Keys are shorter than terms: pairs are made distinct before their terms are made.
                t = t.select(m.s.cell().alias("s"), m.o.cell().alias("o")).distinct()
                s_term, o_term = m.s.made(F.col("s")), m.o.made(F.col("o"))
            else:
                s_term, o_term = m.s.made(), m.o.made()
                repeated = repeated or name not in self.functional
            parts.append(t.select(s_term.alias("s"), F.lit(name).alias("p"), o_term.alias("o")))
        if not parts:
            return self.spark.createDataFrame([], "graph string, s string, p string, o string")
        rows = union(parts).where("s is not null and o is not null").select(self.graph.alias("graph"), "s", "p", "o")
        return rows.distinct() if repeated else rows


def triples(spark: SparkSession, sf_dir: str, predicates: list[str], graph: Column | None = None) -> DataFrame:
    """(graph, s, p, o) of some predicates as one DataFrame."""
    return Tables(spark, sf_dir, predicates, graph).rows()
