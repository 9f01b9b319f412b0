"""Joins of incoming records with known entities and prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import literal
from .paths import union


#: Prefixes of the shortest lengths that are sent to all tasks, and rows whose keys one task tells apart.
SENT, ROWS = 50_000, 500_000


def longest_prefix(rows: DataFrame, key: str, table: DataFrame, prefix: str = "prefix", value: str = "value") -> DataFrame:
    """``rows`` with the ``value`` of the longest ``prefix`` of their ``key`` in ``table`` (null if none).

    For each length that occurs in the table a key has one beginning: equality joins, no ranges. The
    lengths, at most the longest prefix, are the only thing that is collected. Short prefixes are few and many
    keys share one, so they are sent to the keys; the number of tasks grows with the rows.
    """
    own = table.where(F.length(prefix) > 0).groupBy(prefix).agg(F.min(value).alias(value))
    counts = sorted(own.groupBy(F.length(prefix).alias("n")).agg(F.count("*").alias("c")).collect())
    if not counts:
        return rows.withColumn(value, F.lit(None).cast(table.schema[value].dataType))
    short, total = [], 0
    for n, c in counts:
        total += c
        if total <= SENT:
            short.append(n)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    keys = rows.select(key).where(F.col(key).isNotNull()).repartition(tasks, key).distinct()

    def found(lengths: list[int], sent: bool) -> DataFrame:
        # Different lengths within the key give different beginnings.
        fit = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(key))
        cuts = keys.select(key, F.explode(fit).alias("_n")).select(key, F.substring(F.col(key), F.lit(1), F.col("_n")).alias(prefix))
        own_here = own.where(F.length(prefix).isin(lengths))
        return cuts.join(F.broadcast(own_here), prefix) if sent else cuts.join(own_here, prefix)

    long = [n for n, _ in counts[len(short) :]]
    parts = [found(ns, sent) for ns, sent in ((short, True), (long, False)) if ns]
    best = union(parts).groupBy(key).agg(F.max_by(value, F.length(prefix)).alias(value))
    return rows.join(best, key, "left")


def bits(address: Column) -> Column:
    """A hexadecimal address of at most 16 digits, with any separators, as a text of its bits."""
    digits = F.regexp_replace(address, "[^0-9A-Fa-f]", "")
    return F.when(F.length(digits) > 0, F.lpad(F.conv(digits, 16, 2), 4 * F.length(digits), "0"))


def prefix_table(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, short, long) of files with lines ``prefix[/length] TAB short [TAB long]``; ``#`` begins a comment.

    Prefixes are texts of bits, cut to their length if they state one, and meet :func:`bits` of an address in
    :func:`longest_prefix`. Blank lines and lines without a prefix or a short name are left out.
    """
    line = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    cells = F.split("value", "\t")
    cell = lambda i: F.nullif(F.trim(F.regexp_replace(F.get(cells, F.lit(i)), r"(?:^|\s)#.*$", "")), F.lit(""))
    rows = line.select(cell(0).alias("head"), cell(1).alias("short"), cell(2).alias("long"))
    length = F.regexp_extract("head", r"/\s*([0-9]+)$", 1).try_cast("int")
    own = bits(F.regexp_replace("head", r"/.*$", ""))
    return rows.select(F.when(length.isNull(), own).otherwise(F.substring(own, F.lit(1), length)).alias("prefix"), "short", "long").where("prefix is not null and short is not null")


def resolve_entities(rows: DataFrame, known: DataFrame, predicate: str, key: str, minted: str = "urn:entity:") -> DataFrame:
    """``rows`` with a column entity: the known subject of (predicate, key) or a new one, minted from the key.

    ``key`` is a text column; it is looked up as a plain literal. Equal keys mint equal entities, so a
    repeated batch makes nothing new. Of several known subjects the smallest is taken.
    """
    own = known.where(F.col("p") == predicate).groupBy(F.col("o").alias("_o")).agg(F.min("s").alias("_s"))
    new = F.concat(F.lit(minted), F.sha2(F.concat(F.lit(predicate), F.lit("\t"), F.col(key)), 256))
    return rows.join(own, literal(F.col(key)) == F.col("_o"), "left").withColumn("entity", F.coalesce("_s", new)).drop("_s", "_o")


def explode_triples(rows: DataFrame, graph: str, *triples: tuple[Column, str, Column]) -> DataFrame:
    """Several triples from every row (a stream's too): (subject, predicate, object); those with a null are left out."""
    cells = F.array(*[F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o")) for s, p, o in triples])
    return rows.select(F.explode(cells).alias("t")).select(F.lit(graph).alias("graph"), "t.s", "t.p", "t.o").where("s is not null and o is not null")


def dict_triples(tree: dict, subject: str | None = None) -> list[tuple[str, str, str]]:
    """Triples of a nested dict ``{subject: {predicate: object or list or dict}}`` as a list of rows."""
    if subject is None:
        return [t for s, inner in tree.items() for t in dict_triples(inner, s)]
    out = []
    for p, objects in tree.items():
        for o in objects if isinstance(objects, list) else [objects]:
            if isinstance(o, dict):
                out += [x for name, inner in o.items() for x in [(subject, p, name), *dict_triples(inner, name)]]
            else:
                out.append((subject, p, o))
    return out
