"""Logical queries: trees of $and and $or over leaves that ask something of one key or of all."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from quillseek import errors

AND, OR, PATH, VALUE = "$and", "$or", "$path", "$val"


@dataclass
class Leaf:
    """key: an id, or None for all keys.  query: a string, or an object query."""

    key: str | None
    query: Any

    def to_dict(self) -> dict:
        return {"keyId": self.key, ("pattern" if isinstance(self.query, str) else "fieldQuery"): self.query}


@dataclass
class Node:
    operator: str
    children: list[Leaf | Node] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {"children": [c.to_dict() for c in self.children], "operator": self.operator}


def _key_id(key) -> str:
    return ".".join(key) if isinstance(key, (list, tuple)) else str(key)


def _is_tree(query) -> bool:
    return isinstance(query, dict) and any(query.get(op) or isinstance(query.get(op), (list, tuple, dict)) for op in (AND, OR))


def _spread(query: dict) -> dict:
    """All entries of an object as a conjunction."""
    return {AND: [{k: v} for k, v in query.items()]}


def _leaf(key, query) -> Leaf:
    if isinstance(query, str) or isinstance(query, dict):
        return Leaf(_key_id(key), query)
    raise errors.invalid_value_for_key(_key_id(key))


def _parse(query) -> Leaf | Node:
    if isinstance(query, str):
        return Leaf(None, query)
    if not isinstance(query, dict) or not query:
        raise errors.SearchError("a logical query consists of strings and non-empty objects")
    if _is_tree(query):
        lists = [v for v in query.values() if isinstance(v, (list, tuple))]
        return Node(next(iter(query)), [_parse(item) for members in lists for item in members])
    if query.get(PATH):
        return _leaf(query[PATH], query.get(VALUE))
    if len(query) > 1:
        return _parse(_spread(query))
    return _leaf(*next(iter(query.items())))


def parse(query: dict) -> Leaf | Node:
    """The tree of a query; a root that isn't $and or $or is a conjunction of its entries."""
    return _parse(query if _is_tree(query) else _spread(query))


def leaves(node: Leaf | Node) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for c in node.children for x in leaves(c)]


def fold_tree(node: Leaf | Node, leaf: Callable[[Leaf], Any], all_of: Callable[[list], Any], some_of: Callable[[list], Any]):
    """Evaluate a tree from its leaves up."""
    if isinstance(node, Leaf):
        return leaf(node)
    done = [fold_tree(c, leaf, all_of, some_of) for c in node.children]
    return all_of(done) if node.operator == AND else some_of(done)
