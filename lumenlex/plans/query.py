"""Search expressions, and the short text form of them.

``a b`` means all of them, ``AND`` binds closer than ``OR``, ``NOT`` is a
prefix, ``field:term`` names a field.  White space is that of the analyzers.  There are no brackets or quotes: richer
expressions are put together in Python with ``&``, ``|`` and ``~``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from typing import ClassVar

from lumenlex.errors import MaxDepthExceeded, MaxNodesExceeded, ParseError
from lumenlex.functions.analysis import trimmed, words

MAX_DEPTH, MAX_NODES, NODE_CAP = 32, 1024, 65535


class Node:
    children: tuple[Node, ...]

    def __and__(self, other: Node) -> And:
        return And((self, other))

    def __or__(self, other: Node) -> Or:
        return Or((self, other))

    def __invert__(self) -> Not:
        return Not((self,))

    def walk(self) -> Iterator[Node]:
        """This node and all below it, parents first."""
        yield self
        for child in self.children:
            yield from child.walk()

    @property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children), default=0)


@dataclass(frozen=True)
class Term(Node):
    """A term in a field (by name or id), or in all fields."""

    children: ClassVar[tuple[Node, ...]] = ()
    text: str
    field: str | int | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase(Node):
    """Can be put together and inspected, not run."""

    children: ClassVar[tuple[Node, ...]] = ()
    terms: tuple[str, ...]
    slop: int = 0


@dataclass(frozen=True)
class And(Node):
    children: tuple[Node, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Or(Node):
    children: tuple[Node, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Not(Node):
    children: tuple[Node, ...]


@dataclass(frozen=True)
class Constant(Node):
    """The child's matches, all with one score; 0 if it is not finite."""

    children: tuple[Node, ...]
    score: float


@dataclass(frozen=True)
class External(Node):
    """The child's matches that the filter of a slot accepts."""

    children: tuple[Node, ...]
    slot: int


@dataclass(frozen=True)
class Where(Node):
    """The child's matches whose attributes meet a predicate (see :mod:`lumenlex.operators.predicates`)."""

    children: tuple[Node, ...]
    predicate: object


def boosted(node: Node, factor: float) -> Node:
    """A term, conjunction or disjunction with its boost multiplied."""
    return replace(node, boost=node.boost * factor)


def parse(text: str) -> Node:
    def term(part: str) -> Node:
        field, colon, value = part.partition(":")
        if not colon:
            field, value = None, part
        several = words(value)
        if not value or field is not None and len(several) > 1:
            raise ParseError(text)
        return Term(value, field) if len(several) < 2 else And(tuple(map(Term, several)))

    def unary(part: str) -> Node:
        nots, part = 0, trimmed(part)
        while part.startswith("NOT "):
            nots, part = nots + 1, trimmed(part[4:])
        if not part:
            raise ParseError(text)
        node = term(part)
        for _ in range(nots):
            node = ~node
        return node

    def conjunction(part: str) -> Node:
        parts = trimmed(part).split(" AND ")
        return unary(parts[0]) if len(parts) == 1 else And(tuple(map(unary, parts)))

    parts = trimmed(text).split(" OR ")
    return conjunction(parts[0]) if len(parts) == 1 else Or(tuple(map(conjunction, parts)))


def checked(node: Node, fields: int = 1, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Node:
    """The node, if it keeps the limits; a term in all of several fields counts once for each field and once more."""
    if node.depth > max_depth:
        raise MaxDepthExceeded(max_depth, node.depth)
    max_nodes = min(max_nodes, NODE_CAP)
    count = sum(1 + (fields if isinstance(n, Term) and n.field is None and fields > 1 else 0) for n in node.walk())
    if count > max_nodes:
        raise MaxNodesExceeded(max_nodes, count)
    return node
