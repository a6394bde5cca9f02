"""Query trees by chained calls.

``QueryBuilder.scan("a").cross(QueryBuilder.scan("b")).filter("a1", "EQ", column("b1")).project("a1", "id").build()``
"""

from __future__ import annotations

from lathe.plans.ir import Cross, Filter, Node, Predicate, Project, Query, Scan, Sort, SortKey, Value


def column(name: str) -> Value:
    return Value("Column", name)


def i32(value: int) -> Value:
    return Value("I32", value)


def i64(value: int) -> Value:
    return Value("I64", value)


def f32(value: float) -> Value:
    return Value("F32", value)


def f64(value: float) -> Value:
    return Value("F64", value)


def string(value: str) -> Value:
    return Value("String", value)


class _Many:
    def __init__(self, *first) -> None:
        self.items: list = []
        self.add(*first)


class MultiProjectBuilder(_Many):
    def add(self, source: str, name: str) -> MultiProjectBuilder:
        self.items.append((source, name))
        return self


class MultiSortBuilder(_Many):
    def add(self, name: str, ascending: bool = True) -> MultiSortBuilder:
        self.items.append(SortKey(name, ascending))
        return self


class MultiPredicateBuilder(_Many):
    def add(self, name: str, operator: str, value: Value) -> MultiPredicateBuilder:
        self.items.append(Predicate(name, operator, value))
        return self


class QueryBuilder:
    def __init__(self, node: Node) -> None:
        self.node = node

    @classmethod
    def scan(cls, table: str) -> QueryBuilder:
        return cls(Scan(table))

    def filter(self, name: str, operator: str, value: Value) -> QueryBuilder:
        return self.filter_multiple(MultiPredicateBuilder(name, operator, value))

    def filter_multiple(self, tests: MultiPredicateBuilder) -> QueryBuilder:
        return QueryBuilder(Filter(tuple(tests.items), self.node))

    def cross(self, other: QueryBuilder) -> QueryBuilder:
        return QueryBuilder(Cross(self.node, other.node))

    def sort(self, name: str, ascending: bool = True) -> QueryBuilder:
        return self.sort_multiple(MultiSortBuilder(name, ascending))

    def sort_multiple(self, keys: MultiSortBuilder) -> QueryBuilder:
        return QueryBuilder(Sort(tuple(keys.items), self.node))

    def project(self, source: str, name: str) -> QueryBuilder:
        return self.project_multiple(MultiProjectBuilder(source, name))

    def project_multiple(self, columns: MultiProjectBuilder) -> QueryBuilder:
        return QueryBuilder(Project(tuple(columns.items), self.node))

    def build(self) -> Query:
        return Query(self.node)
