"""Connected components of an edge list, as a loop of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, component) for every id in ``edges``; the component is its smallest id.

    Alternates two rewirings of the edges: every node's larger neighbours are hung on its smallest
    neighbour, then every node and its smaller neighbours are. Stars result after about the logarithm of
    the longest chain's length. An edge list without rows gives no rows; loops and repeats do no harm.
    Groupings only take a minimum, so they combine before the shuffle and no group is gathered.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v").distinct()
    e = cut(e, "edges")
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        new = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        # The fixed point: every node hangs on one other, which itself hangs on none.
        parents = new.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        deep = new.join(parents.select(F.col("u").alias("v")), "v", "left_semi")
        changed = not parents.where("low < high").select("u").union(deep.select("u")).isEmpty()
        e = new
        if not changed:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
