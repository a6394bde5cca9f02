"""The query tree and its JSON form: each node is an object with its name as the one key."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

OPERATORS = ("EQ", "NE", "GT", "GTE", "LT", "LTE")
LITERALS = ("I32", "I64", "F32", "F64", "String")


class IRError(ValueError):
    """A tree or a JSON text that is not well formed."""


@dataclass(frozen=True)
class Value:
    """A column's name (kind ``Column``) or a literal of the kind's type."""

    kind: str
    value: Any

    def __post_init__(self) -> None:
        good = {"Column": str, "String": str, "I32": int, "I64": int, "F32": (int, float), "F64": (int, float)}.get(self.kind)
        if good is None or not isinstance(self.value, good) or isinstance(self.value, bool):
            raise IRError(f"bad value {self.value!r} of kind {self.kind!r}")
        bits = {"I32": 31, "I64": 63}.get(self.kind)
        if bits and not -(1 << bits) <= self.value < 1 << bits:
            raise IRError(f"{self.value} is no {self.kind}")


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    value: Value

    def __post_init__(self) -> None:
        if self.operator not in OPERATORS:
            raise IRError(f"unknown operator {self.operator!r}")


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class Scan:
    table: str


@dataclass(frozen=True)
class Filter:
    predicates: tuple[Predicate, ...]
    child: Node


@dataclass(frozen=True)
class Project:
    columns: tuple[tuple[str, str], ...]
    child: Node


@dataclass(frozen=True)
class Cross:
    left: Node
    right: Node


@dataclass(frozen=True)
class Sort:
    keys: tuple[SortKey, ...]
    child: Node


Node = Scan | Filter | Project | Cross | Sort


@dataclass(frozen=True)
class Query:
    root: Node


def _node_out(node: Node) -> dict:
    match node:
        case Scan(table):
            return {"Scan": {"table_id": table}}
        case Filter(predicates, child):
            tests = [{"column_name": p.column, "operator": p.operator, "value": {p.value.kind: p.value.value}} for p in predicates]
            return {"Filter": {"predicates": tests, "underlying": _node_out(child)}}
        case Project(columns, child):
            return {"Project": {"column_name_map": [list(c) for c in columns], "underlying": _node_out(child)}}
        case Cross(left, right):
            return {"Cross": {"left": _node_out(left), "right": _node_out(right)}}
        case Sort(keys, child):
            specs = [{"column_name": k.column, "ascending": k.ascending} for k in keys]
            return {"Sort": {"sort_specs": specs, "underlying": _node_out(child)}}
    raise IRError(f"no node: {node!r}")


def to_json(query: Query, indent: int | None = None) -> str:
    return json.dumps({"root": _node_out(query.root)}, indent=indent)


def _one(obj: Any) -> tuple[str, Any]:
    if not isinstance(obj, dict) or len(obj) != 1:
        raise IRError(f"expected an object with one key, not {obj!r}")
    return next(iter(obj.items()))


def _node_in(obj: Any) -> Node:
    kind, body = _one(obj)
    try:
        match kind:
            case "Scan":
                return Scan(str(body["table_id"]))
            case "Filter":
                tests = (Predicate(p["column_name"], p["operator"], Value(*_one(p["value"]))) for p in body["predicates"])
                return Filter(tuple(tests), _node_in(body["underlying"]))
            case "Project":
                return Project(tuple((str(a), str(b)) for a, b in body["column_name_map"]), _node_in(body["underlying"]))
            case "Cross":
                return Cross(_node_in(body["left"]), _node_in(body["right"]))
            case "Sort":
                keys = (SortKey(k["column_name"], bool(k["ascending"])) for k in body["sort_specs"])
                return Sort(tuple(keys), _node_in(body["underlying"]))
    except (KeyError, TypeError) as e:
        raise IRError(f"malformed {kind}: {e}") from e
    raise IRError(f"unknown node {kind!r}")


def from_json(text: str) -> Query:
    try:
        obj = json.loads(text)
    except json.JSONDecodeError as e:
        raise IRError(f"no JSON: {e}") from e
    if not isinstance(obj, dict) or "root" not in obj:
        raise IRError("a query is an object with the key root")
    return Query(_node_in(obj["root"]))
