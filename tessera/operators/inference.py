"""Forward inference to a fixpoint: inverse predicates and equal subjects.

Both rules are joins with triples of the same graph. Every round joins only what is new (semi-naive).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.terms import INVERSE, SAME
from .paths import union


def inverse_pairs(triples: DataFrame) -> DataFrame:
    """(graph, p, q): predicates that are inverse to each other, both ways round."""
    one = triples.where(F.col("p") == INVERSE).select("graph", F.col("s").alias("p"), F.col("o").alias("q"))
    return one.union(one.select("graph", F.col("q").alias("p"), F.col("p").alias("q"))).distinct()


def equal_pairs(triples: DataFrame) -> DataFrame:
    """(graph, s, t): what is said of s also holds of t."""
    return triples.where(F.col("p") == SAME).select("graph", "s", F.col("o").alias("t")).where("s != t").distinct()


def _inverse(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    return triples.join(pairs, ["graph", "p"]).select("graph", F.col("o").alias("s"), F.col("q").alias("p"), F.col("s").alias("o"))


def _equal(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    return triples.join(pairs, ["graph", "s"]).select("graph", F.col("t").alias("s"), "p", "o")


#: Rows up to which the part of a table that they meet is sought first.
FEW = 1_000_000


def _lacking(rows: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Those of the distinct ``rows``, a written table, that none of ``tables`` has.

    Of few rows only the part of a table that they meet is looked at, so that they go to a large table and not
    the other way round.
    """
    cols = ["graph", "s", "p", "o"]
    tables = [t.select(*cols) for t in tables]
    if tables and rows.count() <= FEW:
        tables = [t.join(rows, cols, "left_semi") for t in tables]
    return rows.join(union(tables), cols, "left_anti") if tables else rows


def derive(known: DataFrame, new: DataFrame, inverse: bool = True, same: bool = True) -> DataFrame:
    """All triples that follow from ``known`` and ``new`` and are in neither, if ``known`` is complete alone.

    Columns graph, s, p, o; ``new`` has each triple once. Literals get no triples of their own as subjects.
    ``known`` is only read, and joined whole only with rules that a round finds; what is written is new.
    """
    cols = ["graph", "s", "p", "o"]
    front, found = new.select(*cols), []
    tables = [known.select(*cols)]
    turned = False
    while inverse or same:
        rules = not front.where(F.col("p").isin([INVERSE] * inverse + [SAME] * same)).isEmpty()
        total = [*tables, front]
        # Rules are a small table of their own: without any, nothing is joined.
        swaps = cut(inverse_pairs(union(total)), "rules") if inverse else None
        twins = cut(equal_pairs(union(total)), "rules") if same else None
        out = []
        if swaps is not None and not swaps.isEmpty():
            back = swaps
            if turned and not rules:
                # All of the front was turned by these pairs: with one partner, it would only turn back.
                back = swaps.join(swaps.groupBy("graph", "p").agg(F.count("*").alias("n")).where("n > 1").select("graph", "p"), ["graph", "p"], "left_semi")
            if back is swaps or not back.isEmpty():
                out.append(_inverse(front, back))
            if rules:
                out += [_inverse(t, inverse_pairs(front)) for t in tables]
        unequal = twins is None or twins.isEmpty()
        if not unequal:
            out.append(_equal(front, twins))
            if rules:
                out += [_equal(t, equal_pairs(front)) for t in tables]
        if not out:
            break
        rows = cut(union(out).where(~F.col("s").startswith('"')).distinct(), "follows")
        fresh = cut(_lacking(rows, total), "derived")
        if fresh.isEmpty():
            break
        found.append(fresh)
        tables, front, turned = total, fresh, unequal
    return union(found) if found else new.select(*cols).limit(0)


def closed(triples: DataFrame, inverse: bool = True, same: bool = True) -> DataFrame:
    """Distinct triples with everything that follows from them."""
    cols = ["graph", "s", "p", "o"]
    t = cut(triples.select(*cols).distinct(), "triples")
    return t.union(derive(t.limit(0), t, inverse, same))


def added(known: DataFrame, new: DataFrame) -> tuple[DataFrame, bool]:
    """What to append to a complete graph when ``new`` arrives, and whether that is anything."""
    cols = ["graph", "s", "p", "o"]
    fresh = cut(new.select(*cols).distinct(), "arrived")
    if not known.isEmpty():
        fresh = cut(_lacking(fresh, [known]), "fresh")
    # Nothing new, nothing to follow; all parts are written already.
    return (fresh.union(derive(known, fresh)), True) if not fresh.isEmpty() else (fresh, False)


def content(triples: DataFrame) -> DataFrame:
    """(graph, n, digest): number and order-free digest of each graph's distinct triples: the sum of the first 60
    bits of each one's MD5."""
    d = triples.select("graph", "s", "p", "o").distinct()
    part = F.conv(F.substring(F.md5(F.concat_ws("\t", "s", "p", "o")), 1, 15), 16, 10).cast("decimal(38,0)")
    return d.groupBy("graph").agg(F.count("*").alias("n"), F.sum(part).cast("string").alias("digest"))
