"""The library's front: graphs of triples and what can be asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.terms import PREFIXES, expand
from .operators import match
from .operators.inference import added, closed, content
from .operators.paths import relation
from .plans.query import Path, Query, as_path


class Graph:
    """Triples (graph, s, p, o) with prefixes.

    >>> g.select([("?c", "t:inNation", "?n"), ("?n", "t:inRegion", "?r")], ["c", "r"])
    """

    def __init__(self, triples, prefixes: dict[str, str] | None = None):
        """``triples`` is a DataFrame (graph, s, p, o) or a source that is asked by constants, such as
        :class:`~tessera.sources.tables.Tables`."""
        self.source = match.as_source(triples.select("graph", "s", "p", "o") if isinstance(triples, DataFrame) else triples)
        self.prefixes = PREFIXES | (prefixes or {})

    @property
    def triples(self) -> DataFrame:
        return self.source.df if isinstance(self.source, match.Triples) else self.source.rows()

    @staticmethod
    def of(spark: SparkSession, rows: list[tuple[str, str, str]], graph: str = "main", prefixes: dict[str, str] | None = None) -> Graph:
        known = PREFIXES | (prefixes or {})
        return Graph(spark.createDataFrame([(graph, expand(s, known), expand(p, known, True), expand(o, known)) for s, p, o in rows], "graph string, s string, p string, o string"), prefixes)

    def query(self, where, select=(), graphs=(), unions=()) -> Query:
        """The query with its terms expanded, ready to send elsewhere as JSON."""
        return match.resolve(Query.of(where, select, graphs, unions), self.prefixes)

    def run(self, query: Query) -> DataFrame:
        return match.select(self.source, query)

    def select(self, where, select=(), graphs=(), unions=()) -> DataFrame:
        """Distinct bindings in each graph; rows of several graphs stand together."""
        return self.run(self.query(where, select, graphs, unions))

    def count(self, where, select=(), graphs=(), unions=()) -> int:
        return self.select(where, select, graphs, unions).count()

    def construct(self, where, template, graph: str, select=(), unions=()) -> DataFrame:
        """Triples of ``graph`` made of each binding."""
        q = self.query(template)
        return match.construct(self.select(where, select, (), unions), list(q.where), graph)

    def graphs(self) -> DataFrame:
        return self.triples.select("graph").distinct()

    def out_edges(self, s: str, p: str | None = None) -> DataFrame:
        return self.source.rows(s=self._x(s), p=self._p(p))

    def in_edges(self, o: str, p: str | None = None) -> DataFrame:
        return self.source.rows(o=self._x(o), p=self._p(p))

    def predicates(self, node: str) -> DataFrame:
        x = self._x(node)
        return self.source.rows(s=x).select("p").union(self.source.rows(o=x).select("p")).distinct()

    def endpoints(self, p: str) -> DataFrame:
        return self.source.rows(p=self._p(p)).select("graph", "s", "o")

    def neighbour_classes(self, cls: str) -> DataFrame:
        """(p, other, n): the classes that subjects of a class have edges to, by predicate."""
        return match.neighbour_classes(self.source, self._x(cls))

    def relation(self, path: Path | str) -> DataFrame:
        """All pairs that a path joins."""
        return relation(self.source, as_path(path).map(lambda t: expand(t, self.prefixes, True)))

    def closed(self) -> Graph:
        """With everything that follows from inverse predicates and equal subjects."""
        return Graph(closed(self.triples), self.prefixes)

    def add(self, triples: DataFrame) -> tuple[Graph, bool]:
        """This (complete) graph with new triples and what follows; whether anything changed."""
        more, changed = added(self.triples, triples)
        return (Graph(self.triples.union(more), self.prefixes) if changed else self), changed

    def content(self) -> DataFrame:
        return content(self.triples)

    def chunks(self, where, select=(), size: int = 400):
        """Rows of a query in lists of at most ``size``, the last one too, without holding all on the driver."""
        rows: list = []
        for r in self.select(where, select).toLocalIterator():
            rows.append(r)
            if len(rows) == size:
                yield rows
                rows = []
        if rows:
            yield rows

    def _x(self, t: str) -> str:
        return expand(t, self.prefixes)

    def _p(self, p: str | None) -> str | None:
        return None if p is None else expand(p, self.prefixes, True)
