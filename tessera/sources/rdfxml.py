"""RDF/XML: files are read whole, one per task, with the standard library's XML parser.

Nodes by about, ID and nodeID; property attributes; typed nodes; resource, nodeID, datatype and language;
parseType Resource, Collection and Literal; containers (rdf:li); reification by rdf:ID; xml:base.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import RDF, TYPE
from .turtle import ROWS, _files

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


class _Reader:
    def __init__(self, label: str):
        self.label, self.made, self.rows = label, 0, []

    def blank(self) -> str:
        self.made += 1
        return f"_:{self.label}-anon{self.made}"

    def name(self, e: ET.Element, base: str) -> str | None:
        if (v := e.get(_R + "about")) is not None:
            return urljoin(base, v)
        if (v := e.get(_R + "ID")) is not None:
            return urljoin(base, "#" + v)
        if (v := e.get(_R + "nodeID")) is not None:
            return f"_:{self.label}-{v}"
        return None

    def text(self, value: str, lang: str | None, kind: str | None = None) -> str:
        return f'"{value}"' + (f"^^{kind}" if kind else f"@{lang}" if lang else "")

    def attributes(self, e: ET.Element, s: str, lang: str | None) -> bool:
        """Property attributes of ``e`` as triples; whether there were any."""
        any_ = False
        for key, value in e.attrib.items():
            if key.startswith("{") and not key.startswith((_R, _XML)):
                self.rows.append((s, key[1:].replace("}", ""), self.text(value, lang)))
                any_ = True
            elif key == _R + "type":
                self.rows.append((s, TYPE, value))
                any_ = True
        return any_

    def node(self, e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = urljoin(base, e.get(_XML + "base", "")), e.get(_XML + "lang", lang)
        s = self.name(e, base) or self.blank()
        if e.tag != _R + "Description":
            self.rows.append((s, TYPE, e.tag[1:].replace("}", "")))
        self.attributes(e, s, lang)
        self.properties(e, s, base, lang)
        return s

    def properties(self, e: ET.Element, s: str, base: str, lang: str | None) -> None:
        number = 0
        for q in e:
            if q.tag == _R + "li":
                number += 1
                p = f"{RDF}_{number}"
            else:
                p = q.tag[1:].replace("}", "")
            o = self.value(q, base, q.get(_XML + "lang", lang))
            self.rows.append((s, p, o))
            if (v := q.get(_R + "ID")) is not None:
                r = urljoin(base, "#" + v)
                self.rows += [(r, TYPE, RDF + "Statement"), (r, RDF + "subject", s), (r, RDF + "predicate", p), (r, RDF + "object", o)]

    def value(self, q: ET.Element, base: str, lang: str | None) -> str:
        base, how = urljoin(base, q.get(_XML + "base", "")), q.get(_R + "parseType")
        if how == "Resource":
            o = self.blank()
            self.properties(q, o, base, lang)
            return o
        if how == "Collection":
            items = [self.node(x, base, lang) for x in q]
            o = RDF + "nil"
            for x in reversed(items):
                cell = self.blank()
                self.rows += [(cell, RDF + "first", x), (cell, RDF + "rest", o)]
                o = cell
            return o
        if how is not None:
            inner = escape(q.text or "") + "".join(ET.tostring(x, encoding="unicode") for x in q)
            return self.text(inner, None, RDF + "XMLLiteral")
        if (v := q.get(_R + "resource")) is not None:
            o = urljoin(base, v)
            self.attributes(q, o, lang)
            return o
        if (v := q.get(_R + "nodeID")) is not None:
            return f"_:{self.label}-{v}"
        if len(q):
            if len(q) > 1:
                raise ValueError(f"{q.tag} holds more than one node")
            return self.node(q[0], base, lang)
        if not (q.text or "").strip() and any(k.startswith("{") and not k.startswith((_R + "ID", _R + "datatype", _XML)) for k in q.attrib):
            o = self.blank()
            self.attributes(q, o, lang)
            return o
        return self.text(q.text or "", lang, q.get(_R + "datatype"))

    def read(self, text: str, base: str) -> Iterator[list[tuple[str, str, str]]]:
        parser = ET.XMLPullParser(["start-ns", "end"])
        parser.feed(text)
        parser.close()
        root = None
        for event, found in parser.read_events():
            if event == "end":
                root = found
            elif found[0] and not re.fullmatch(r"ns\d+", found[0]):
                # Markup inside literals keeps the file's own prefixes.
                ET.register_namespace(*found)
        if root.tag == _R + "RDF":
            base, lang = urljoin(base, root.get(_XML + "base", "")), root.get(_XML + "lang")
            for e in root:
                self.node(e, base, lang)
                if len(self.rows) >= ROWS:
                    yield self.rows
                    self.rows = []
        else:
            self.node(root, base, None)
        yield self.rows


def read(spark: SparkSession, path: str, graph: str, base: str = "") -> DataFrame:
    """(graph, s, p, o) of RDF/XML files; a bad text is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text, label in zip(f.text, f.label, strict=True):
                for rows in _Reader(label).read(text, base):
                    yield pd.DataFrame(rows, columns=["s", "p", "o"])

    return _files(spark, path).mapInPandas(run, "s string, p string, o string").select(F.lit(graph).alias("graph"), "s", "p", "o").distinct()
