"""Graphs and views kept up to date by Structured Streaming.

A stream of triples is folded into a store batch by batch: what is new and what follows from it is
appended, and every view (a query and a template of triples) is recomputed and appended where it
changed. Batches may be repeated after a failure: only triples that are not there yet are appended.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.terms import PREFIXES
from ..operators.match import construct, resolve, select
from ..plans.query import Pattern, Query
from ..sources.store import TRIPLES, Store


@dataclass(frozen=True)
class View:
    """A query whose rows are published as triples of ``graph``.

    The template is the query's own patterns unless given; it may only use selected variables.
    """

    name: str
    query: Query
    graph: str = "public"
    template: tuple[Pattern, ...] = ()

    def rows(self, store: Store) -> DataFrame:
        q = resolve(self.query, PREFIXES)
        return select(store.triples(*q.graphs), q)

    def triples(self, store: Store) -> DataFrame:
        patterns = self.template or self.query.where
        own = resolve(Query.of(patterns), PREFIXES).where
        return construct(self.rows(store), list(own), self.graph)


def refresh(store: Store, views: list[View], into: Store | None = None) -> list[str]:
    """Recompute the views and append what they newly say to ``into``; the names of those that changed."""
    target = into or store
    return [v.name for v in views if target.add(v.triples(store))]


def _fold(store: Store, views: list[View], target: Store | None):
    def batch(df: DataFrame, number: int) -> None:
        store.add(df.where("s is not null and p is not null and o is not null").select(F.coalesce("graph", F.lit("main")).alias("graph"), "s", "p", "o"))
        # Also after a batch without news: a repeated one may find views that are behind.
        refresh(store, views, target)

    return batch


def follow(stream: DataFrame, store: Store, checkpoint: str, views: list[View] | None = None, into: Store | None = None, every: str | None = None) -> StreamingQuery:
    """Fold a stream of triples (graph, s, p, o) into ``store`` and keep ``views`` (in ``into``) up to date.

    Runs once over what is there, or every interval (``"10 seconds"``).
    """
    writer = stream.writeStream.foreachBatch(_fold(store, views or [], into)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def subscribe(source: Store, store: Store, checkpoint: str, graph: str = "public", to: str = "peer", views: list[View] | None = None, every: str | None = None) -> StreamingQuery:
    """Replicate a graph of another store: its appended files are the change log, offsets are in the checkpoint.

    The rows become triples of the graph ``to``; then this store's own views are refreshed, so that
    changes travel on to its subscribers.
    """
    spark = store.spark
    stream = spark.readStream.schema(TRIPLES).parquet(f"{source.folder}/triples").where(F.col("graph") == graph)
    return follow(stream.select(F.lit(to).alias("graph"), "s", "p", "o"), store, checkpoint, views, None, every)


def watch(stream: DataFrame, store: Store, query: Query, name: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A continuous query: after each batch its rows replace the temporary view ``name``."""
    fold = _fold(store, [], None)

    def batch(df: DataFrame, number: int) -> None:
        fold(df, number)
        q = resolve(query, PREFIXES)
        select(store.triples(*q.graphs), q).createOrReplaceGlobalTempView(name)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
