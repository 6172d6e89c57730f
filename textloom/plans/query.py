"""Query trees."""

from __future__ import annotations

from dataclasses import dataclass, replace

MUST, SHOULD, MUST_NOT = "+", "", "-"
MAX_CLAUSES = 1024


@dataclass(frozen=True)
class Query:
    boost: float = 1.0

    def boosted(self, boost: float) -> Query:
        return replace(self, boost=self.boost * boost)

    def _tail(self) -> str:
        return "" if self.boost == 1.0 else f"^{self.boost}"

    def rewrite(self) -> Query:
        return self


@dataclass(frozen=True)
class Term(Query):
    """Documents that hold a term. doc_freq, if given, takes the place of the index's in idf."""

    field: str = ""
    term: str = ""
    doc_freq: int | None = None

    def __str__(self):
        return f"{self.field}:{self.term}{self._tail()}"


@dataclass(frozen=True)
class Pattern(Query):
    """Documents that hold a term of a set, all at the score of the boost. kind: prefix, wildcard, regexp, fuzzy or range."""

    kind: str = "prefix"
    field: str = ""
    text: str = ""
    upper: str | None = None
    inclusive: bool = True
    edits: int = 2

    def __str__(self):
        shown = {"prefix": f"{self.text}*", "wildcard": self.text, "regexp": f"/{self.text}/", "fuzzy": f"{self.text}~{self.edits}"}
        a, b = "[]" if self.inclusive else "{}"
        return f"{self.field}:{shown.get(self.kind, f'{a}{self.text} TO {self.upper}{b}')}{self._tail()}"


@dataclass(frozen=True)
class Phrase(Query):
    """Documents that hold terms at successive positions; with slop, within so many moves in order."""

    field: str = ""
    terms: tuple[str, ...] = ()
    slop: int = 0

    def __str__(self):
        return f'{self.field}:"{" ".join(self.terms)}"' + (f"~{self.slop}" if self.slop else "") + self._tail()


@dataclass(frozen=True)
class MatchAll(Query):
    def __str__(self):
        return f"*:*{self._tail()}"


@dataclass(frozen=True)
class Boolean(Query):
    """Clauses (occur, query) in order; a repeated clause counts again."""

    clauses: tuple[tuple[str, Query], ...] = ()
    disable_coord: bool = False
    min_should: int = 0

    def __post_init__(self):
        if len(self.clauses) > MAX_CLAUSES:
            raise ValueError(f"more than {MAX_CLAUSES} clauses")

    def rewrite(self) -> Query:
        """A boolean of one clause that isn't prohibited is that clause, at the product of the boosts."""
        inner = replace(self, clauses=tuple((o, q.rewrite()) for o, q in self.clauses))
        if len(inner.clauses) == 1 and inner.clauses[0][0] != MUST_NOT and inner.min_should <= 1:
            occur, only = inner.clauses[0]
            if occur == MUST or inner.min_should in (0, 1):
                return only.boosted(self.boost)
        return inner

    def __str__(self):
        parts = [o + (f"({q})" if isinstance(q, Boolean) and not q._tail() and not q.min_should else str(q)) for o, q in self.clauses]
        out = " ".join(parts)
        if self.boost != 1.0 or self.min_should:
            out = f"({out})"
        return out + (f"~{self.min_should}" if self.min_should else "") + self._tail()


def should(*queries: Query, **more) -> Boolean:
    return Boolean(clauses=tuple((SHOULD, q) for q in queries), **more)


def must(*queries: Query, **more) -> Boolean:
    return Boolean(clauses=tuple((MUST, q) for q in queries), **more)
