"""Property paths over triples as DataFrame joins and fixpoints.

A relation has the columns graph, s, o and holds each row once. Fixpoints are loops of joins; each
round's new rows are written as a table of the shared folder, so plans stay short and rounds survive a
lost executor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..plans.query import Path


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nodes(triples) -> DataFrame:
    """Every subject and object: (graph, n)."""
    triples = triples.rows()
    return triples.select("graph", F.col("s").alias("n")).union(triples.select("graph", F.col("o").alias("n"))).distinct()


def compose(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs (a.s, b.o) with a.o = b.s, in each graph."""
    return a.withColumnRenamed("o", "mid").join(b.select("graph", F.col("s").alias("mid"), "o"), ["graph", "mid"]).select("graph", "s", "o").distinct()


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """As :func:`compose`, each pair as often as it has a middle."""
    return a.withColumnRenamed("o", "mid").join(b.select("graph", F.col("s").alias("mid"), "o"), ["graph", "mid"]).select("graph", "s", "o")


def _doubled(edges: DataFrame) -> DataFrame:
    """The closure of distinct ``edges``: ``exact`` has the pairs whose shortest path has 2^k edges, ``shorter`` those below.

    A shortest path of 2^k to 2^(k+1) edges is cut behind its first 2^k, so few pairs are found more than once.
    """
    cols = ["graph", "s", "o"]
    exact, shorter = edges, []
    while True:
        if shorter:
            known = union([*shorter, exact])
            more = _joined(exact, union(shorter)).distinct().join(known, cols, "left_anti")
            shorter += [exact, cut(more, "closure")]
        else:
            shorter = [exact]
        exact = cut(_joined(exact, exact).distinct().join(union(shorter), cols, "left_anti"), "closure")
        if exact.isEmpty():
            return union(shorter)


def _closed(edges: DataFrame) -> DataFrame:
    """The closure of a table of distinct edges. Subjects that no edge leads to need no rounds: they reach their
    objects and what these reach."""
    cols = ["graph", "s", "o"]
    led = edges.select("graph", F.col("o").alias("s")).distinct()
    core = _doubled(cut(edges.join(led, ["graph", "s"], "left_semi").select(*cols), "edges"))
    outer = cut(edges.join(led, ["graph", "s"], "left_anti").select(*cols), "edges")
    several = cut(outer.groupBy("graph", "s").agg(F.count("*").alias("n")).where("n > 1").select("graph", "s"), "several")
    if several.isEmpty():
        # With one object each, all their pairs are different.
        return union([core, outer, _joined(outer, core.where("s != o"))])
    one, more = outer.join(several, ["graph", "s"], "left_anti").select(*cols), outer.join(several, ["graph", "s"], "left_semi").select(*cols)
    return union([core, one, _joined(one, core.where("s != o")), more.union(_joined(more, core)).distinct()])


def closure(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All pairs that one or more edges join, each once: rounds grow as the logarithm of the longest path.

    With ``known``, pairs that are closed by themselves, only what ``edges`` add to them is found.
    """
    cols = ["graph", "s", "o"]
    new = edges.select(*cols).distinct()
    if known is None or known.isEmpty():
        return _closed(cut(new, "edges"))
    known = known.select(*cols)
    new = cut(new.join(known, cols, "left_anti"), "edges")
    # A path with new edges is a known one or none, and then stretches of a new edge and a known path or none.
    stretches = cut(new.union(_joined(new, known)).distinct(), "stretches")
    found = cut(_closed(stretches), "closure")
    return found.union(_joined(known, found)).distinct().join(known, cols, "left_anti")


#: Hops that one round of a walk makes, and rounds after which the visited pairs become one table.
HOPS, ROUNDS = 4, 8


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Pairs (s, o) of seeds ``(graph, n)`` and what one or more edges reach from them; only their part is walked.

    A round makes HOPS hops in one job; what is new in its last hop is where the next one begins.
    """
    cols = ["graph", "s", "o"]
    edges = cut(edges, "edges")
    front = seeds.select("graph", F.col("n").alias("s"), F.col("n").alias("o")).distinct()
    visited: list[DataFrame] = []
    while True:
        hops = [compose(front, edges)]
        while len(hops) < HOPS:
            hops.append(compose(hops[-1], edges))
        rows = union([h.withColumn("hop", F.lit(i)) for i, h in enumerate(hops)]).groupBy(*cols).agg(F.min("hop").alias("hop"))
        rows = cut(rows.join(union(visited), cols, "left_anti") if visited else rows, "reach")
        visited.append(rows.select(*cols))
        front = rows.where(F.col("hop") == HOPS - 1).select(*cols)
        if front.isEmpty():
            return union(visited)
        if len(visited) == ROUNDS:
            visited = [cut(union(visited), "reach")]


def _flip(df: DataFrame) -> DataFrame:
    return df.select("graph", F.col("o").alias("s"), F.col("s").alias("o"))


def relation(triples, path: Path, from_: DataFrame | None = None, to: DataFrame | None = None) -> DataFrame:
    """All pairs (graph, s, o) that ``path`` joins; ``triples`` is asked by predicate (``rows(p=...)``).

    ``from_`` and ``to`` are known ends, (graph, n): only pairs that begin (end) there are asked for, and
    repeated paths are walked from there. A path that may be empty also joins every node of the graph, or
    every known end, with itself.
    """
    if path.op == "p":
        return limit(triples.rows(p=path.parts[0]).select("graph", "s", "o"), from_, to)
    if path.op == "|":
        return union([relation(triples, p, from_, to) for p in path.parts]).distinct()  # type: ignore[arg-type]
    if path.op == "/":
        first, second = path.parts
        if from_ is not None or to is None:
            a = relation(triples, first, from_, None)  # type: ignore[arg-type]
            if from_ is not None:
                a = cut(a, "hop")
                mid = a.select("graph", F.col("o").alias("n")).distinct()
            else:
                mid = None
            return compose(a, relation(triples, second, mid, to))  # type: ignore[arg-type]
        b = cut(relation(triples, second, None, to), "hop")  # type: ignore[arg-type]
        return compose(relation(triples, first, None, b.select("graph", F.col("s").alias("n")).distinct()), b)  # type: ignore[arg-type]
    # A source may keep closures of single predicates.
    stored = getattr(triples, "closure", None) if path.op != "?" else None
    plain = path.parts[0].op == "p"  # type: ignore[union-attr]
    inner = relation(triples, path.parts[0]) if stored is None or not plain else None  # type: ignore[arg-type]
    if inner is None:
        hop = limit(stored(path.parts[0].parts[0]), from_, to)  # type: ignore[misc, union-attr]
    elif path.op == "?":
        hop = limit(inner, from_, to)
    elif from_ is not None:
        hop = limit(reach(inner, from_), None, to)
    elif to is not None:
        hop = _flip(reach(_flip(inner), to))
    else:
        hop = closure(inner)
    if path.op == "+":
        return hop
    ends = from_ if from_ is not None else to if to is not None else nodes(triples)
    same = limit(ends.select("graph", F.col("n").alias("s"), F.col("n").alias("o")).distinct(), from_, to)
    # The pairs of a hop are distinct: only those of a node with itself can be there twice.
    return hop.union(same.join(hop.where("s = o"), ["graph", "s", "o"], "left_anti"))


def limit(rel: DataFrame, from_: DataFrame | None, to: DataFrame | None) -> DataFrame:
    """Pairs that begin in ``from_`` and end in ``to``, where given."""
    if from_ is not None:
        rel = rel.join(from_.select("graph", F.col("n").alias("s")), ["graph", "s"], "left_semi")
    if to is not None:
        rel = rel.join(to.select("graph", F.col("n").alias("o")), ["graph", "o"], "left_semi")
    return rel.select("graph", "s", "o")
