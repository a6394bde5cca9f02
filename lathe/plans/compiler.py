"""Query trees to DataFrames, bottom up."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lathe.operators.relational import PlanError, crossed, filtered, projected, sorted_by
from lathe.plans.catalog import Catalog
from lathe.plans.ir import Cross, Filter, Node, Project, Query, Scan, Sort

__all__ = ["PlanError", "compile_query", "with_runtime_filters"]


def compile_query(query: Query, catalog: Catalog, semantics: str = "spark", join_hint: str | None = None) -> DataFrame:
    """The query's result, not yet computed.

    ``join_hint`` goes to every cross; ``auto`` asks for a sorted merge where the catalog's statistics say that both sides
    of the first key are in order and dense, and leaves the rest to Spark. With statistics in the catalog, a scan whose
    range excludes a literal that it is compared with is left out (the result is empty all the same).
    """
    if semantics not in ("spark", "reference"):
        raise PlanError(f"unknown semantics {semantics!r}")
    hint = _hint(query.root, catalog) if join_hint == "auto" else join_hint

    def of(node: Node) -> DataFrame:
        match node:
            case Scan(table):
                return catalog.table(table)
            case Filter(predicates, child):
                found = filtered(of(child), predicates, semantics)
                outside = isinstance(child, Scan) and any(_excluded(catalog.range_of(child.table, p.column), p) for p in predicates)
                return found.limit(0) if outside else found
            case Project(columns, child):
                return projected(of(child), columns)
            case Cross(left, right):
                return crossed(of(left), of(right), hint)
            case Sort(keys, child):
                return sorted_by(of(child), keys)
        raise PlanError(f"no node: {node!r}")

    return of(query.root)


def _excluded(bounds: tuple | None, predicate) -> bool:
    """No value within the bounds can hold the predicate. Only numbers of like kinds are judged: whole with whole, else doubles."""
    if bounds is None or predicate.value.kind not in ("I32", "I64", "F64"):
        return False
    (low, high), x = bounds, predicate.value.value
    if not all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (low, high)) or x != x:
        return False
    if isinstance(low, float) or isinstance(x, float):
        low, high, x = float(low), float(high), float(x)
    return {"EQ": x < low or x > high, "GT": high <= x, "GTE": high < x, "LT": low >= x, "LTE": low > x}.get(predicate.operator, False)


def with_runtime_filters(df: DataFrame, scan_bytes: int = 0, broadcast_bytes: int = -1) -> DataFrame:
    """The same rows, planned with Bloom filters: the keys of a join's selective side are tested at the other side's scan.

    Spark does this by itself for scans of 10 GB; here it does for scans of more than ``scan_bytes``, and broadcasts only
    sides of up to ``broadcast_bytes`` (none: -1), as a broadcast side needs no filter. The plan is made at once; the
    session's settings stay as they are.
    """
    conf, wanted = df.sparkSession.conf, {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": str(scan_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(broadcast_bytes),
    }
    before = {k: conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            conf.set(k, v)
        out = df.select("*")
        out._jdf.queryExecution().executedPlan()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return out


def _hint(node: Node, catalog: Catalog, least_density: float = 0.1) -> str | None:
    """``merge`` if the first equality of two columns joins two ordered, dense columns."""
    tests: list = []
    while not isinstance(node, (Scan, Cross)):
        tests += node.predicates if isinstance(node, Filter) else ()
        node = node.child
    if isinstance(node, Scan):
        return None
    for p in tests:
        if p.operator == "EQ" and p.value.kind == "Column":
            stats = [catalog.column_statistics(x.rpartition(".")[2]) for x in (p.column, p.value.value)]
            good = all(s and s.get("physically_ordered") and s.get("density", 0) >= least_density for s in stats)
            return "merge" if good else None
    return None
