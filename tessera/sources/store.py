"""Graphs as a Parquet table partitioned by graph, with prefixes and a registry of loaded bundles."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.terms import PREFIXES
from ..operators.inference import added, closed
from ..operators.match import Triples
from ..operators.paths import closure, union
from . import lines, rdfxml, turtle

TRIPLES = "graph string, s string, p string, o string"


def read_rdf(spark: SparkSession, path: str, graph: str, fmt: str | None = None, base: str = "") -> DataFrame:
    """(graph, s, p, o) of files of one format: ttl, nt, nq or rdf; by the path's ending if not given."""
    fmt = fmt or path.rsplit(".", 1)[-1]
    if fmt in ("nt", "nq"):
        return _parsed(spark, path, graph, fmt, base).distinct()
    return _parsed(spark, path, graph, fmt, base)


def _parsed(spark: SparkSession, path: str, graph: str, fmt: str | None = None, base: str = "") -> DataFrame:
    """As :func:`read_rdf`; a statement of N-Triples or N-Quads as often as it is there."""
    fmt = fmt or path.rsplit(".", 1)[-1]
    if fmt in ("nt", "nq"):
        if base:
            raise ValueError("N-Triples and N-Quads know no base")
        return lines.read(spark, path, graph)
    if fmt in ("ttl", "turtle"):
        return turtle.read(spark, path, graph, base)
    if fmt in ("rdf", "xml", "owl"):
        return rdfxml.read(spark, path, graph, base)
    raise ValueError(f"unknown format {fmt!r}")


@dataclass(frozen=True)
class Bundle:
    """A graph's name, its data files and the ontologies that are merged into it."""

    graph: str
    data: tuple[str, ...] = ()
    ontologies: tuple[str, ...] = field(default=())

    def key(self) -> str:
        return json.dumps([self.graph, self.data, self.ontologies])


class Store:
    """A folder with the tables triples, prefixes and bundles. Appends never rewrite what is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def triples(self, *graphs: str) -> DataFrame:
        """All triples, or those of some graphs: only their partitions are read."""
        t = self._table("triples", TRIPLES).select("graph", "s", "p", "o")
        return t.where(F.col("graph").isin(list(graphs))) if graphs else t

    def graphs(self) -> DataFrame:
        return self.triples().select("graph").distinct()

    def prefixes(self, graph: str) -> dict[str, str]:
        """The graph's own prefixes over the general ones; a prefix declared twice keeps the smallest IRI."""
        own = self._table("prefixes", "graph string, prefix string, iri string").where(F.col("graph") == graph).groupBy("prefix").agg(F.min("iri"))
        return PREFIXES | {r[0]: r[1] for r in own.collect()}

    def append(self, triples: DataFrame) -> None:
        triples.select("graph", "s", "p", "o").write.mode("append").partitionBy("graph").parquet(f"{self.folder}/triples")

    def add(self, triples: DataFrame, infer: bool = True) -> bool:
        """Append what is new in ``triples`` and what follows from it; whether anything was.

        Only the graphs that ``triples`` has are read.
        """
        new = triples.select("graph", "s", "p", "o")
        graphs = [r[0] for r in new.select("graph").distinct().collect()]
        known = self.triples(*graphs) if graphs else self.triples().limit(0)
        if infer:
            fresh, changed = added(known, new)
        else:
            fresh = new.distinct().join(known, ["graph", "s", "p", "o"], "left_anti")
            changed = not fresh.isEmpty()
        if changed:
            self.append(fresh)
        return changed

    def _digest(self, bundle: Bundle) -> str:
        files = self.spark.read.format("binaryFile").load(list(bundle.data + bundle.ontologies))
        each = F.sort_array(F.collect_list(F.sha2("content", 256)))
        return files.agg(F.sha2(F.concat_ws("|", each), 256)).first()[0]

    def load(self, bundle: Bundle) -> bool:
        """Load a bundle into its graph, unless the same files with the same content were loaded before."""
        digest = self._digest(bundle) if bundle.data or bundle.ontologies else ""
        known = self._table("bundles", "key string, sha256 string")
        if not known.where((F.col("key") == bundle.key()) & (F.col("sha256") == digest)).isEmpty():
            return False
        files = bundle.data + bundle.ontologies
        if files:
            # Files are parsed once, whatever is asked of their triples.
            self.add(cut(union([_parsed(self.spark, f, bundle.graph) for f in files]), "loaded"))
            names = [turtle.prefixes(self.spark, f, bundle.graph) for f in files if f.endswith("ttl")]
            if names:
                union(names).distinct().write.mode("append").parquet(f"{self.folder}/prefixes")
        self.spark.createDataFrame([(bundle.key(), digest)], "key string, sha256 string").write.mode("append").parquet(f"{self.folder}/bundles")
        return True

    def backup(self, path: str) -> None:
        self.triples().write.partitionBy("graph").parquet(f"{path}/triples")
        self._table("prefixes", "graph string, prefix string, iri string").write.parquet(f"{path}/prefixes")

    @staticmethod
    def restore(spark: SparkSession, path: str) -> Store:
        """A backup is a store's folder: nothing has to be copied."""
        return Store(spark, path)

    def source(self, *closures: str) -> StoreSource:
        """The store to be asked by patterns; of the predicates ``closures``, repeated paths are kept in the store."""
        return StoreSource(self, closures)

    def closure(self, predicate: str) -> DataFrame:
        """(graph, s, o): what one or more edges of ``predicate`` join, from the stored pairs of it.

        Edges that came since are closed with the stored pairs, and only what they add is appended.
        """
        name = f"closures/{sha256(predicate.encode()).hexdigest()[:16]}"
        known = self._table(name, "graph string, s string, o string")
        edges = self.triples().where(F.col("p") == predicate).select("graph", "s", "o")
        new = edges.join(known, ["graph", "s", "o"], "left_anti")
        if not new.isEmpty():
            closure(new, known).write.mode("append").parquet(f"{self.folder}/{name}")
        return self._table(name, "graph string, s string, o string")

    def infer(self, graph: str) -> bool:
        """Append what follows within a graph whose triples were appended without inference."""
        t = self.triples(graph)
        fresh = closed(t).join(t, ["graph", "s", "p", "o"], "left_anti")
        changed = not fresh.isEmpty()
        if changed:
            self.append(fresh)
        return changed


class StoreSource(Triples):
    """A store's triples as a source for patterns. Appends are of new triples only, so rows are distinct."""

    def __init__(self, store: Store, closures: tuple[str, ...] = ()):
        super().__init__(store.triples(), distinct=True)
        self.store, self.closures = store, closures
        if closures:
            self.closure = self._closure

    def _closure(self, predicate: str) -> DataFrame:
        if predicate in self.closures:
            return self.store.closure(predicate)
        return closure(self.rows(p=predicate).select("graph", "s", "o"))
