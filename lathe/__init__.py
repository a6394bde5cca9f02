"""Lathe: a small relational algebra on Spark.

Queries are trees of five nodes (scan, filter, project, cross, sort), built in Python or read from JSON, and compiled into
DataFrames. Catalyst plans them: it pushes filters and columns into scans, turns filters over crosses into joins, and
picks join algorithms.
"""

from lathe.plans.builder import MultiPredicateBuilder, MultiProjectBuilder, MultiSortBuilder, QueryBuilder
from lathe.plans.catalog import Catalog
from lathe.plans.compiler import PlanError, compile_query
from lathe.plans.ir import Query, from_json, to_json

__all__ = ["Catalog", "MultiPredicateBuilder", "MultiProjectBuilder", "MultiSortBuilder", "PlanError", "Query", "QueryBuilder", "compile_query", "from_json", "to_json"]
