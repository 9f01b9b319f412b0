"""Queries over graphs as plain data: terms, property paths, patterns, and what to return.

>>> Query.of([("?x", "a", "t:Cell"), ("?x", step("t:feeds").plus / "t:partOf", "?y")], select=["x", "y"])
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Path:
    """A property path: a predicate, or a sequence or choice of paths, with a mark ``?``, ``*``, ``+`` or none."""

    op: str
    parts: tuple[Path | str, ...]

    @property
    def optional(self) -> Path:
        return Path("?", (self,))

    @property
    def star(self) -> Path:
        return Path("*", (self,))

    @property
    def plus(self) -> Path:
        return Path("+", (self,))

    def __truediv__(self, other: Path | str) -> Path:
        return Path("/", (self, as_path(other)))

    def __or__(self, other: Path | str) -> Path:
        return Path("|", (self, as_path(other)))

    def __str__(self) -> str:
        if self.op == "p":
            return str(self.parts[0])
        if self.op in "/|":
            return "(" + self.op.join(map(str, self.parts)) + ")"
        return f"{self.parts[0]}{self.op}"

    def map(self, f) -> Path:
        """The same path with every predicate replaced."""
        return Path(self.op, tuple(p.map(f) if isinstance(p, Path) else f(p) for p in self.parts))

    def predicates(self) -> set[str]:
        return set().union(*[p.predicates() if isinstance(p, Path) else {p} for p in self.parts])

    def plain(self) -> str | None:
        """The predicate of a path that is one step."""
        return self.parts[0] if self.op == "p" else None  # type: ignore[return-value]

    def data(self):
        return [self.op, *[p.data() if isinstance(p, Path) else p for p in self.parts]]

    @staticmethod
    def of(data) -> Path:
        return Path(data[0], tuple(Path.of(x) if isinstance(x, list) else x for x in data[1:]))


def step(predicate: str) -> Path:
    return Path("p", (predicate,))


def as_path(p: Path | str) -> Path:
    """A path; a text with a last ``?``, ``*`` or ``+`` is a marked step, one with ``/`` between names a sequence."""
    if isinstance(p, Path):
        return p
    if p.startswith("?"):
        return step(p)
    if "/" in p and "://" not in p and not p.startswith("<"):
        first, *rest = [as_path(x) for x in p.split("/")]
        for x in rest:
            first = first / x
        return first
    if p[-1:] in ("?", "*", "+"):
        return Path(p[-1], (step(p[:-1]),))
    return step(p)


@dataclass(frozen=True)
class Pattern:
    s: str
    p: Path
    o: str

    @staticmethod
    def of(t) -> Pattern:
        return t if isinstance(t, Pattern) else Pattern(t[0], as_path(t[1]), t[2])

    def terms(self) -> list[str]:
        p = self.p.plain()
        return [self.s, *([p] if p else []), self.o]

    def variables(self) -> list[str]:
        return list(dict.fromkeys(t[1:] for t in self.terms() if t.startswith("?")))


@dataclass(frozen=True)
class Query:
    """Distinct bindings of ``select`` (all variables if empty) over patterns in each of ``graphs`` (all if empty).

    ``unions`` are further groups of patterns: bindings of ``where`` together with any one of each list's groups.
    """

    where: tuple[Pattern, ...]
    select: tuple[str, ...] = ()
    graphs: tuple[str, ...] = ()
    unions: tuple[tuple[tuple[Pattern, ...], ...], ...] = field(default=())

    @staticmethod
    def of(where, select=(), graphs=(), unions=()) -> Query:
        group = lambda ps: tuple(Pattern.of(t) for t in ps)
        return Query(group(where), tuple(v.lstrip("?") for v in select), tuple(graphs), tuple(tuple(group(g) for g in u) for u in unions))

    def variables(self) -> list[str]:
        own = [v for p in self.where for v in p.variables()]
        return list(dict.fromkeys(own + [v for u in self.unions for g in u for p in g for v in p.variables()]))

    def to_json(self) -> str:
        group = lambda ps: [[p.s, p.p.data(), p.o] for p in ps]
        return json.dumps({"where": group(self.where), "select": self.select, "graphs": self.graphs, "unions": [[group(g) for g in u] for u in self.unions]})

    @staticmethod
    def from_json(text: str) -> Query:
        d = json.loads(text)
        group = lambda ps: [Pattern(s, Path.of(p), o) for s, p, o in ps]
        return Query.of(group(d["where"]), d["select"], d["graphs"], [[group(g) for g in u] for u in d["unions"]])

    def __str__(self) -> str:
        """The query in the usual notation, for people to read."""
        group = lambda ps: "{ " + " . ".join(f"{p.s} {p.p} {p.o}" for p in ps) + " }"
        body = " . ".join([f"{p.s} {p.p} {p.o}" for p in self.where] + [" UNION ".join(map(group, u)) for u in self.unions])
        source = f" FROM {' '.join(self.graphs)}" if self.graphs else ""
        return f"SELECT {' '.join('?' + v for v in self.select) or '*'}{source} WHERE {{ {body} }}"
