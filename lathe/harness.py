"""Runs query cases and compares their text with expected files."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path

from lathe.plans.builder import QueryBuilder
from lathe.plans.catalog import Catalog
from lathe.plans.compiler import compile_query
from lathe.plans.ir import Query, from_json, to_json
from lathe.streaming.rows import lines


@dataclass
class QueryCase:
    name: str
    query: Query
    expected_output_file: str
    disabled: bool = False
    sort_before_check: bool = False

    @classmethod
    def of(cls, obj: dict) -> QueryCase:
        return cls(obj["execution_name"], from_json(json.dumps(obj["query"])), obj["expected_output_file"], obj.get("disabled", False), obj.get("sort_before_check", False))


    def as_json(self) -> dict:
        """What ``of`` reads."""
        return {"execution_name": self.name, "disabled": self.disabled, "sort_before_check": self.sort_before_check, "query": json.loads(to_json(self.query)), "expected_output_file": self.expected_output_file}


def save_cases(cases: Iterable[QueryCase], path: str) -> None:
    Path(path).write_text(json.dumps([c.as_json() for c in cases], indent=1))


def load_cases(path: str) -> list[QueryCase]:
    return [QueryCase.of(x) for x in json.loads(Path(path).read_text())]


def scan_cases(catalog: Catalog, folder: str) -> list[QueryCase]:
    """One case for each table, its bare scan, with its result written to ``folder`` as the expected one."""
    out = []
    for name in catalog.tables:
        case = QueryCase(f"scan_{name}", QueryBuilder.scan(name).build(), f"{folder}/{name}.expected", sort_before_check=True)
        with open(case.expected_output_file, "w") as expected:
            expected.writelines(f"{line}\n" for line in lines(compile_query(case.query, catalog)))
        out.append(case)
    return out


@dataclass
class Outcome:
    name: str
    passed: bool
    detail: str = ""


def run_case(case: QueryCase, catalog: Catalog) -> Outcome:
    """Blank expected lines don't count; all other lines must be equal, in order unless ``sort_before_check``."""
    want = [x for x in Path(case.expected_output_file).read_text().split("\n") if x.strip()]
    got = list(lines(compile_query(case.query, catalog)))
    if case.sort_before_check:
        want.sort()
        got.sort()
    if len(want) != len(got):
        return Outcome(case.name, False, f"{len(got)} rows, expected {len(want)}")
    wrong = next((i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b), None)
    return Outcome(case.name, wrong is None, "" if wrong is None else f"row {wrong}: {got[wrong]!r}, expected {want[wrong]!r}")


def run_cases(cases: Iterable[QueryCase], catalog: Catalog) -> list[Outcome]:
    return [run_case(c, catalog) for c in cases if not c.disabled]
