"""N-Triples and N-Quads: one statement per line, read and written with built-in functions.

Files split at any line, so one large file is read by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The lexical rules of the formats.
# Runs of plain characters and escapes never give back what they took, so long terms need no deep stack.
_IRI = r"<([A-Za-z][A-Za-z0-9+.-]*+:(?:[^\x00-\x20<>\"{}|^`\\]++|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+)>"
_NODE = r"(_:[\p{L}0-9_](?:[\p{L}\p{N}_.-]*[\p{L}\p{N}_-])?)"
_TEXT = r'("(?:[^"\\\n\r]++|\\[tbnrf"\'\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*+")(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*)|\^\^' + _IRI + r")?"
STATEMENT = rf"^\s*(?:{_IRI}|{_NODE})\s*{_IRI}\s*(?:{_IRI}|{_NODE}|{_TEXT})\s*(?:(?:{_IRI}|{_NODE})\s*)?\.\s*(?:#.*)?$"
#: Groups of the statement: subject (iri, node), predicate, object (iri, node, text, language, datatype), graph (iri, node).
_S, _P, _O, _G = (1, 2), (3,), (4, 5, 6, 7, 8), (9, 10)
DEFAULT = "_:defaultGraph"

_MARKS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(c: Column) -> Column:
    """Backslash escapes of a text as the characters they stand for."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    marks = F.create_map(*[F.lit(x) for pair in _MARKS.items() for x in pair])

    def one(x: Column) -> Column:
        code = F.conv(F.substring(x, 3, 8), 16, 10).cast("int")
        # A code point as UTF-32, which the decoder of that name turns into a character.
        wide = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(x.rlike(r"^\\[uU]"), wide).when(x.startswith("\\"), F.element_at(marks, F.substring(x, 2, 1))).otherwise(x)

    return F.when(c.contains("\\"), F.array_join(F.transform(parts, one), "")).otherwise(c)


def escape(c: Column) -> Column:
    for char, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(char), F.lit(mark))
    return c


def read(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """(graph, s, p, o) of N-Triples or N-Quads files; a bad line is an error that shows it.

    A statement's own graph comes first, then ``graph``, then the default graph. Blank nodes are named
    after their file, so equal labels of two files stay apart.
    """
    line = spark.read.text(path).select(F.col("value").alias("line"), F.crc32(F.input_file_name().cast("binary")).alias("file"))
    line = line.where(~F.col("line").rlike(r"^\s*(?:#.*)?$"))
    bad = F.raise_error(F.concat(F.lit("not a statement: "), F.substring("line", 1, 200)))
    # One pass of the expression over a line: its groups, which hold no line ends, on a line each.
    groups = "\n" + "".join(f"${i}\n" for i in range(1, 11))
    rows = line.select("line", F.split(F.regexp_replace("line", STATEMENT, groups), "\n").alias("groups"), "file")
    rows = rows.select(F.when(F.size("groups") == 12, F.col("groups")).otherwise(bad).alias("groups"), "file")
    g = lambda i: F.col("groups")[i]
    node = lambda i: F.when(g(i) != "", F.concat(F.lit("_:f"), F.col("file"), F.lit("-"), F.substring(g(i), 3, 1 << 20)))
    iri = lambda i: F.when(g(i) != "", unescape(g(i)))
    text = F.concat(F.lit('"'), unescape(F.expr("substring(t, 2, length(t) - 2)")), F.lit('"'))
    rows = rows.withColumn("t", g(_O[2]))
    lit = F.when(F.col("t") != "", F.concat(text, F.when(g(_O[3]) != "", F.concat(F.lit("@"), g(_O[3]))).when(g(_O[4]) != "", F.concat(F.lit("^^"), unescape(g(_O[4])))).otherwise("")))
    own = F.coalesce(iri(_G[0]), node(_G[1]), F.lit(graph or DEFAULT))
    return rows.select(own.alias("graph"), F.coalesce(iri(_S[0]), node(_S[1])).alias("s"), iri(_P[0]).alias("p"), F.coalesce(iri(_O[0]), node(_O[1]), lit).alias("o"))


def spelled(c: Column) -> Column:
    """A term as the formats write it."""
    parts = r'(?s)^"(.*)"(@[A-Za-z0-9-]+)?(?:\^\^(.+))?$'
    kind = F.regexp_extract(c, parts, 3)
    lit = F.concat(F.lit('"'), escape(F.regexp_extract(c, parts, 1)), F.lit('"'), F.regexp_extract(c, parts, 2), F.when(kind != "", F.concat(F.lit("^^<"), kind, F.lit(">"))).otherwise(""))
    plain = F.concat(F.lit('"'), escape(F.substring(c, F.lit(2), F.length(c) - 2)), F.lit('"'))
    return F.when(c.startswith('"') & c.endswith('"'), plain).when(c.startswith('"'), lit).when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))


def statements(triples: DataFrame, quads: bool = False) -> DataFrame:
    """One column, value: a line per triple, with its graph if ``quads``."""
    cells = [spelled(F.col(c)) for c in ("s", "p", "o")] + ([spelled(F.col("graph"))] if quads else [])
    return triples.select(F.concat_ws(" ", *cells, F.lit(".")).alias("value"))


def write(triples: DataFrame, path: str, quads: bool = False) -> None:
    statements(triples, quads).write.text(path)
