"""Turtle: files are read whole, one per task, and written sorted, with prefixes.

Prefixes and blank nodes make a file one unit, so parallelism is by file. A small tokenizer and a
statement reader turn each text into rows; everything after is columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, TYPE, XSD
from .lines import _MARKS, spelled

# The tokens of the format.
_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r\n]+|\#[^\n]*)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<text>\"{3}(?:\"{0,2}(?:[^"\\]|\\.))*\"{3}|'{3}(?:'{0,2}(?:[^'\\]|\\.))*'{3}|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<node>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<name>[^\W\d_]?[\w.-]*:(?:[\w:%-]|\\[-_~.!$&'()*+,;=/?\#@%]|\.(?=[\w:%\\.-]))*)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


#: Triples that a reader holds at a time.
ROWS = 50_000


class TurtleError(ValueError):
    """A text that is not Turtle, with the line."""


def _plain(text: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "uU" and len(x) > 1:
            return chr(int(x[1:], 16))
        if x not in _MARKS:
            raise TurtleError(f"unknown escape \\{x}")
        return _MARKS[x]

    return _ESCAPE.sub(one, text)


class _File:
    """Rows of one text: a cursor over its tokens."""

    def __init__(self, text: str, label: str, base: str = ""):
        self.text, self.label, self.base = text, label, base
        self.prefixes: dict[str, str] = {}
        self.rows: list[tuple[str, str, str]] = []
        self.made = 0
        self.tokens = self._lex()
        self.next = next(self.tokens)

    def _lex(self) -> Iterator[tuple[str, str, int]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if not m or m.end() == at:
                self.fail(f"unexpected {self.text[at : at + 20]!r}", at)
            if m.lastgroup != "skip":
                yield m.lastgroup or "", m[0], at
            at = m.end()
        yield "end", "", at

    def fail(self, why: str, at: int | None = None) -> None:
        at = self.next[2] if at is None else at
        raise TurtleError(f"line {self.text.count(chr(10), 0, at) + 1}: {why}")

    def take(self) -> tuple[str, str]:
        kind, text, _ = self.next
        if kind == "end":
            self.fail("the text ends within a statement")
        self.next = next(self.tokens)
        return kind, text

    def expect(self, mark: str) -> None:
        if self.next[1] != mark:
            self.fail(f"{mark!r} expected, not {self.next[1]!r}")
        self.take()

    def blank(self) -> str:
        self.made += 1
        return f"_:{self.label}-anon{self.made}"

    def iri(self, text: str) -> str:
        x = _plain(text[1:-1])
        if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", x):
            return x
        return urljoin(self.base, x) if self.base else x

    def name(self, text: str) -> str:
        prefix, _, local = text.partition(":")
        if prefix not in self.prefixes:
            self.fail(f"unknown prefix {prefix!r}")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def term(self, subject: bool = False) -> str:
        kind, text = self.take()
        if kind == "iri":
            return self.iri(text)
        if kind == "name":
            return self.name(text)
        if kind == "node":
            return f"_:{self.label}-{text[2:]}"
        if text == "[":
            node = self.blank()
            if self.next[1] != "]":
                self.properties(node)
            self.expect("]")
            return node
        if text == "(":
            return self.collection()
        if not subject:
            if kind == "text":
                long = text[:3] in ('"""', "'''")
                body = '"' + _plain(text[3:-3] if long else text[1:-1]) + '"'
                if self.next[0] == "at":
                    return body + self.take()[1]
                if self.next[0] == "type":
                    self.take()
                    kind, text = self.take()
                    if kind not in ("iri", "name"):
                        self.fail("a datatype is expected behind ^^")
                    return f"{body}^^{self.iri(text) if kind == 'iri' else self.name(text)}"
                return body
            if kind == "number":
                kind = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
                return f'"{text}"^^{XSD}{kind}'
            if text in ("true", "false"):
                return f'"{text}"^^{XSD}boolean'
        self.fail(f"a {'subject' if subject else 'term'} is expected, not {text!r}")
        return ""

    def collection(self) -> str:
        items = []
        while self.next[1] != ")":
            items.append(self.term())
        self.take()
        node = RDF + "nil"
        for item in reversed(items):
            cell = self.blank()
            self.rows += [(cell, RDF + "first", item), (cell, RDF + "rest", node)]
            node = cell
        return node

    def properties(self, subject: str) -> None:
        while True:
            kind, text = self.take()
            if (kind, text) == ("word", "a"):
                p = TYPE
            elif kind in ("iri", "name"):
                p = self.iri(text) if kind == "iri" else self.name(text)
            else:
                self.fail(f"a predicate is expected, not {text!r}")
            while True:
                self.rows.append((subject, p, self.term()))
                if self.next[1] != ",":
                    break
                self.take()
            more = False
            while self.next[1] == ";":
                self.take()
                more = True
            if not more or self.next[1] in (".", "]"):
                return

    def read(self) -> Iterator[list[tuple[str, str, str]]]:
        while self.next[0] != "end":
            kind, text, _ = self.next
            word = text.lstrip("@").lower()
            if kind in ("at", "word") and word in ("prefix", "base"):
                self.take()
                if word == "prefix":
                    kind_, name = self.take()
                    if kind_ != "name" or not name.endswith(":"):
                        self.fail("a prefix is expected")
                kind_, iri = self.take()
                if kind_ != "iri":
                    self.fail("an IRI is expected")
                if word == "prefix":
                    self.prefixes[name[:-1]] = self.iri(iri)
                else:
                    self.base = self.iri(iri)
                if kind == "at":
                    self.expect(".")
                continue
            lone = text == "["
            s = self.term(subject=True)
            if not (lone and self.next[1] == "."):
                self.properties(s)
            self.expect(".")
            if len(self.rows) >= ROWS:
                yield self.rows
                self.rows = []
        yield self.rows


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.concat(F.lit("f"), F.crc32(F.input_file_name().cast("binary"))).alias("label"))


def read(spark: SparkSession, path: str, graph: str, base: str = "") -> DataFrame:
    """(graph, s, p, o) of Turtle files; a bad text is an error with its line."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text, label in zip(f.text, f.label, strict=True):
                for rows in _File(text, label, base).read():
                    yield pd.DataFrame(rows, columns=["s", "p", "o"])

    return _files(spark, path).mapInPandas(run, "s string, p string, o string").select(F.lit(graph).alias("graph"), "s", "p", "o").distinct()


def prefixes(spark: SparkSession, path: str, graph: str) -> DataFrame:
    """(graph, prefix, iri): the prefixes that Turtle files declare."""
    found = F.regexp_extract_all("value", F.lit(r"(?im)^\s*@?prefix\s+[^\s:]*:\s*<[^>]*>"), F.lit(0))
    line = spark.read.text(path, wholetext=True).select(F.explode(found).alias("l"))
    return line.select(F.lit(graph).alias("graph"), F.regexp_extract("l", r"(?i)prefix\s+([^\s:]*):", 1).alias("prefix"), F.regexp_extract("l", "<([^>]*)>", 1).alias("iri")).distinct()


def write(triples: DataFrame, path: str, known: dict[str, str] | None = None) -> None:
    """Turtle files sorted by subject, predicate and object; each starts with the prefixes of ``known``.

    Subjects are dealt out in ranges, so a file's subjects are in no other file unless one subject is hot.
    """
    names = sorted((known or {}).items(), key=lambda x: -len(x[1]))

    def short(t: str) -> str:
        if t.startswith("<"):
            for name, iri in names:
                local = t[1 + len(iri) : -1]
                if t.startswith("<" + iri) and re.fullmatch(r"[A-Za-z_](?:[\w-]*)", local):
                    return f"{name}:{local}"
        return t

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = [f"@prefix {n}: <{i}> ." for n, i in sorted(names)]
        last: tuple[str, str] | None = None
        for f in frames:
            for s, p, o in zip(f.s, f.p, f.o, strict=True):
                p = "a" if p == f"<{TYPE}>" else short(p)
                head, _, kind = o.rpartition("^^")
                o = f"{head}^^{short(kind)}" if head.startswith('"') and kind.startswith("<") else short(o)
                s = short(s)
                if last == (s, p):
                    lines[-1] += f" , {o}"
                elif last and last[0] == s:
                    lines.append(f" ; {p} {o}")
                else:
                    if last:
                        lines.append(".")
                    lines.append(f"{s} {p} {o}")
                last = (s, p)
            if len(lines) > 1:
                yield pd.DataFrame({"value": lines[:-1]})
                lines = lines[-1:]
        if last:
            yield pd.DataFrame({"value": [*lines, "."]})

    rows = triples.select("s", "p", "o").distinct().select(*[spelled(F.col(c)).alias(c) for c in ("s", "p", "o")])
    rows.repartitionByRange("s").sortWithinPartitions("s", "p", "o").mapInPandas(run, "value string").write.text(path)
