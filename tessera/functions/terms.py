"""Terms of a graph as canonical strings, and columns that take them apart.

An IRI is its own text, a literal is ``"text"`` with ``@language`` or ``^^datatype`` behind it, a blank
node is ``_:label``. Equal terms are equal strings, so every join needs one column per position, and a
literal never equals an IRI.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
TYPE, SUBCLASS, LABEL = RDF + "type", RDFS + "subClassOf", RDFS + "label"
INVERSE, SAME = OWL + "inverseOf", OWL + "sameAs"

#: Prefixes that every graph knows.
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}

_LITERAL = r'(?s)^"(.*)"(?:@([A-Za-z0-9-]+)|\^\^(.+))?$'


def expand(term: str, prefixes: dict[str, str], predicate: bool = False) -> str:
    """A term as users write it: ``?var``, ``<iri>``, ``prefix:name``, ``"text"`` with its suffixes, predicate ``a``.

    A prefix that is not known stays as it is: ``c:42`` is then an IRI of the scheme ``c``.
    """
    if term.startswith(("?", "_:")):
        return term
    if term == "a" and predicate:
        return TYPE
    if term.startswith("<") and term.endswith(">"):
        return term[1:-1]
    if term.startswith('"'):
        end = term.rindex('"')
        tail = term[end + 1 :]
        return term[: end + 1] + ("^^" + expand(tail[2:], prefixes) if tail.startswith("^^") else tail)
    head, colon, name = term.partition(":")
    return prefixes[head] + name if colon and head in prefixes else term


def literal(c: Column) -> Column:
    """The plain literal of a text column."""
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def kind(c: Column) -> Column:
    """``lit``, ``bnode`` or ``iri``."""
    return F.when(c.startswith('"'), "lit").when(c.startswith("_:"), "bnode").otherwise("iri")


def text(c: Column) -> Column:
    """A literal's text; other terms as they are."""
    return F.when(c.startswith('"'), F.regexp_extract(c, _LITERAL, 1)).otherwise(c)


def language(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _LITERAL, 2), F.lit(""))


def datatype(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, _LITERAL, 3), F.lit(""))


def namespace(c: Column) -> Column:
    """An IRI up to its ``#``; null without one and for literals."""
    return F.when((kind(c) == "iri") & c.contains("#"), F.substring_index(c, "#", 1))


def local_name(c: Column) -> Column:
    """An IRI behind its ``#``; other terms as :func:`text` gives them."""
    return F.when((kind(c) == "iri") & c.contains("#"), F.regexp_replace(c, r"^[^#]*#", "")).otherwise(text(c))


def number(c: Column) -> Column:
    """A literal's text as a double; null if it is none."""
    return text(c).try_cast("double")


def boolean(c: Column) -> Column:
    return F.when(text(c).isin("true", "1"), True).when(text(c).isin("false", "0"), False)


def matches(c: Column, term: str) -> Column:
    """``c`` is the term; a plain literal is also met by literals of its text with a language or datatype."""
    if term.startswith('"') and term.endswith('"'):
        return (c == term) | c.startswith(term + "@") | c.startswith(term + "^^")
    return c == term
