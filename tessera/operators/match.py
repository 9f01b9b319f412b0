"""Graph patterns: each is a scan of the triples, all are joined on the variables they share.

Catalyst picks the kind of each join, but keeps the order it is given here: mapped scans carry no
statistics. The order is chosen so that rows multiply as little as can be told from the patterns alone
(see :func:`ordered`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms
from ..plans.query import Path, Pattern, Query
from .paths import relation, union


class Triples:
    """A DataFrame (graph, s, p, o) that is asked for triples by constants.

    ``distinct``: its rows are. ``functional``: predicates of which a subject has one object.
    """

    def __init__(self, df: DataFrame, distinct: bool = False, functional: frozenset[str] = frozenset()):
        self.df, self.distinct, self.functional = df, distinct, set(functional)

    def rows(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """(graph, s, p, o), each once, of the triples with these constants."""
        out = self.df
        for column, term in (("s", s), ("p", p), ("o", o)):
            if term is not None:
                out = out.where(terms.matches(F.col(column), term))
        return out if self.distinct else out.distinct()


def as_source(triples):
    """Triples that can be asked by constants: a DataFrame is wrapped, anything else is one already."""
    return Triples(triples) if isinstance(triples, DataFrame) else triples


def _var(t: str) -> bool:
    return t.startswith("?")


def _cost(p: Pattern, known: set[str], few: bool, functional: set[str]) -> int:
    """How much a pattern may multiply the rows that bind ``known``: 0 at most one row for each."""
    mine = set(p.variables())
    if mine <= known:
        return 0
    if not mine & known:
        return 20
    if not _var(p.s) or p.s[1:] in known:
        return 0 if p.p.plain() in functional else 1
    return 1 if few else 3


def ordered(patterns: list[Pattern], functional: set[str]) -> list[Pattern]:
    """The order of joins: a greedy one from each possible first pattern, of which the cheapest is taken.

    Patterns without new variables or with a known subject of a functional predicate come first, then
    other known subjects, then known objects; products come last. To begin with, constants are best: what
    is bound from them is few, so that going from objects to subjects costs little there.
    """

    def greedy(first: Pattern) -> tuple[int, list[Pattern]]:
        few = any(not _var(t) for t in (first.s, first.o))
        out, left, known = [first], [p for p in patterns if p is not first], set(first.variables())
        total = (0 if few else 2) + (1 if first.p.plain() is None else 0)
        while left:
            costs = [_cost(p, known, few, functional) for p in left]
            at = costs.index(min(costs))
            total += costs[at]
            known |= set(left[at].variables())
            out.append(left.pop(at))
        return total, out

    ranked = [greedy(p) for p in sorted(patterns, key=lambda p: (len(p.variables()), p.p.plain() is None))]
    return min(ranked, key=lambda r: r[0])[1]


def _ends(bound: DataFrame | None, triples, term: str) -> DataFrame | None:
    """(graph, n): the known values of one end of a path; a constant is known in the graphs that have it."""
    if not _var(term):
        return triples.rows(s=term).select("graph").union(triples.rows(o=term).select("graph")).distinct().withColumn("n", F.lit(term))
    if bound is not None and term[1:] in bound.columns:
        return bound.select("graph", F.col(term[1:]).alias("n")).distinct()
    return None


def scan(triples, pattern: Pattern, bound: DataFrame | None = None) -> DataFrame:
    """The bindings of one pattern: graph and a column per variable, each row once."""
    spots = {"s": pattern.s, "p": pattern.p.plain(), "o": pattern.o}
    if spots["p"] is None:
        rows = relation(triples, pattern.p, _ends(bound, triples, pattern.s), _ends(bound, triples, pattern.o))
        del spots["p"]
    else:
        rows = triples.rows(**{c: None if _var(t) else t for c, t in spots.items()})
    seen: dict[str, str] = {}
    for column, term in spots.items():
        if _var(term):
            if term[1:] in seen:
                rows = rows.where(F.col(column) == F.col(seen[term[1:]]))
            else:
                seen[term[1:]] = column
    out = rows.select("graph", *[F.col(c).alias(v) for v, c in seen.items()])
    # A plain literal also meets others, so that equal rows can be left.
    return out.distinct() if any(t.startswith('"') for t in spots.values()) else out


def _chains(order: list[Pattern], functional: set[str]) -> list[list[Pattern]]:
    """The order with patterns put together that lead on from each other along functional predicates.

    Such a chain is joined by itself, with a row per first subject, before it meets the many rows of a
    pattern without constants; where constants bind few rows, every pattern stays alone.
    """
    alone = any(not _var(t) for p in order for t in (p.s, p.o))
    out: list[list[Pattern]] = []
    known: set[str] = set()
    for p in order:
        last = out[-1][-1] if len(out) > 1 else None
        leads = last is not None and not alone and all(x.p.plain() in functional for x in (last, p)) and p.s == last.o
        seen = known | {v for x in (out[-1] if out else []) for v in x.variables()}
        # The middle must be bound by the chain alone and the end be new, else it joins elsewhere too.
        if leads and p.s[1:] not in known and p.o[1:] not in seen:
            out[-1].append(p)
        else:
            known |= {v for x in (out[-1] if out else []) for v in x.variables()}
            out.append([p])
    return out


def bindings(triples, patterns: list[Pattern]) -> DataFrame:
    """Joined bindings of all patterns, per graph, each once; patterns without common variables make a product.

    Without patterns there is one empty binding per graph.
    """
    if not patterns:
        return triples.rows().select("graph").distinct()
    out = None
    for p, *chain in _chains(ordered(patterns, triples.functional), triples.functional):
        rows = scan(triples, p, out)
        if chain:
            for x in chain:
                rows = rows.join(scan(triples, x), ["graph", x.s[1:]])
            out = out.join(rows, ["graph", *[v for v in rows.columns if v != "graph" and v in out.columns]])  # type: ignore[union-attr]
        elif out is None:
            out = rows if p.variables() else rows.distinct()
        elif not p.variables():
            out = out.join(rows, "graph", "left_semi")
        else:
            out = out.join(rows, ["graph", *[v for v in p.variables() if v in out.columns]])
    return out  # type: ignore[return-value]


def resolve(query: Query, prefixes: dict[str, str]) -> Query:
    """The query with every term expanded."""
    x = lambda t: terms.expand(t, prefixes)
    step = lambda t: terms.expand(t, prefixes, predicate=True)
    group = lambda ps: [Pattern(x(p.s), p.p.map(step), x(p.o)) for p in ps]
    return Query.of(group(query.where), query.select, query.graphs, [[group(g) for g in u] for u in query.unions])


class _Within:
    """Some graphs of a source."""

    def __init__(self, source, graphs: tuple[str, ...]):
        self.source, self.graphs, self.functional = source, list(graphs), source.functional

    def rows(self, **constants: str | None) -> DataFrame:
        return self.source.rows(**constants).where(F.col("graph").isin(self.graphs))


def select(triples, query: Query) -> DataFrame:
    """Rows of a query whose terms are expanded: distinct in each graph, one column per variable.

    Unbound variables make no row. A selected variable that no pattern has is an error.
    """
    want = list(query.select) or query.variables()
    if missing := set(want) - set(query.variables()):
        raise ValueError(f"selected but in no pattern: {', '.join(sorted(missing))}")
    source = as_source(triples)
    if query.graphs:
        source = _Within(source, query.graphs)
    groups: list[list[Pattern]] = [list(query.where)]
    for u in query.unions:
        groups = [g + list(choice) for g in groups for choice in u]
    parts, whole = [], True
    for g in groups:
        rows = bindings(source, g)
        if all(v in rows.columns for v in want):
            parts.append(rows.select("graph", *want))
            whole = set(rows.columns) == {"graph", *want}
    if not parts:
        raise ValueError("no group of patterns binds all selected variables")
    # Bindings are distinct; only groups together, or variables left out, make equal rows.
    return (parts[0] if len(parts) == 1 and whole else union(parts).distinct()).select(*want)


def construct(rows: DataFrame, template: list[Pattern], graph: str) -> DataFrame:
    """Triples of ``graph``: the template with each row's values put in. Paths have no single triple and are an error."""
    parts = []
    for p in template:
        if p.p.plain() is None:
            raise ValueError(f"a template needs plain predicates: {p.p}")
        cell = lambda t: F.col(t[1:]) if _var(t) else F.lit(t)
        spots = {"s": p.s, "p": p.p.plain(), "o": p.o}
        if missing := [t for t in spots.values() if _var(t) and t[1:] not in rows.columns]:
            raise ValueError(f"not in the rows: {', '.join(missing)}")
        parts.append(rows.select(F.lit(graph).alias("graph"), *[cell(t).alias(c) for c, t in spots.items()]))
    return union(parts).distinct()


def build_patterns(classes: dict[str, str], edges: list[tuple[str, str | Path, str]]) -> list[Pattern]:
    """Patterns of a sketch: a class per variable, and edges between variables."""
    return [Pattern.of((f"?{v}", "a", c)) for v, c in classes.items()] + [Pattern.of((f"?{a}", p, f"?{b}")) for a, p, b in edges]


def neighbour_classes(triples, cls: str) -> DataFrame:
    """(p, other, n): the classes that subjects of class ``cls`` have edges to, by predicate, with the number of edges."""
    source = as_source(triples)
    types = source.rows(p=terms.TYPE).select("graph", F.col("s").alias("n"), F.col("o").alias("class"))
    own = types.where(F.col("class") == cls).select("graph", F.col("n").alias("s"))
    edges = source.rows().where(F.col("p") != terms.TYPE).join(own, ["graph", "s"], "left_semi")
    return edges.join(types.withColumnRenamed("n", "o").withColumnRenamed("class", "other"), ["graph", "o"]).groupBy("p", "other").agg(F.count("*").alias("n"))
