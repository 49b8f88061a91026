"""The query language as immutable values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any


class QueryError(ValueError):
    """A request that cannot be understood or that breaks a bound."""


@dataclass(frozen=True)
class Filter:
    """A predicate over a document. The base class itself matches everything."""


@dataclass(frozen=True)
class Compare(Filter):
    """op is one of eq, ne, gt, gte, lt, lte."""

    op: str
    path: str
    value: Any


@dataclass(frozen=True)
class Member(Filter):
    path: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Exists(Filter):
    path: str
    wanted: bool = True


@dataclass(frozen=True)
class Regex(Filter):
    path: str
    pattern: str
    options: str = ""


@dataclass(frozen=True)
class And(Filter):
    terms: tuple[Filter, ...]


@dataclass(frozen=True)
class Or(Filter):
    terms: tuple[Filter, ...]


@dataclass(frozen=True)
class Not(Filter):
    term: Filter


EVERYTHING = Filter()


@dataclass(frozen=True)
class Projection:
    """Fields to include (all if empty), or to exclude; keep_id tells whether _id stays in include mode."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    keep_id: bool = True


@dataclass(frozen=True)
class SortKey:
    path: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    filter: Filter = EVERYTHING
    projection: Projection | None = None
    sort: tuple[SortKey, ...] = field(default=())
    skip: int | None = None
    limit: int | None = None

    def is_key_lookup(self) -> bool:
        """An equality for one document, with nothing else asked."""
        plain = self.projection is None and not self.sort and self.skip is None
        return plain and self.limit == 1 and isinstance(self.filter, Compare) and self.filter.op == "eq"


def children(node: Filter) -> Sequence[Filter]:
    if isinstance(node, And | Or):
        return node.terms
    return (node.term,) if isinstance(node, Not) else ()


def fields_of(node: Filter) -> list[str]:
    """The paths that a filter reads, each once, in order."""
    own = {node.path} if hasattr(node, "path") else set()
    return sorted(own.union(*(fields_of(c) for c in children(node))))


def served_by(node: Filter, path: str) -> bool:
    """Whether an index on path can serve the filter: any term of an And, every term of an Or, the term of a Not."""
    if isinstance(node, And):
        return any(served_by(t, path) for t in node.terms)
    if isinstance(node, Or):
        return bool(node.terms) and all(served_by(t, path) for t in node.terms)
    if isinstance(node, Not):
        return served_by(node.term, path)
    return getattr(node, "path", None) == path
