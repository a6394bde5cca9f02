"""Tables by name, with declared types and statistics."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Names of the five types in catalog files, and in schema files.
TYPES: dict[str, T.DataType] = {"Int32": T.IntegerType(), "Int64": T.LongType(), "Float32": T.FloatType(), "Float64": T.DoubleType(), "String": T.StringType()}
SCHEMA_TOKENS = {"I32": "Int32", "I64": "Int64", "FLOAT32": "Float32", "FLOAT64": "Float64", "STRING": "String"}
TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def type_name(kind: T.DataType) -> str:
    return next((n for n, t in TYPES.items() if t == kind), kind.simpleString())


@dataclass
class ColumnSpec:
    """A column; statistics are those of ``lathe.operators.statistics``, in the catalog file's form."""

    name: str
    kind: str
    stats: list = field(default_factory=list)

    def facts(self) -> dict:
        """Statistics by plain names."""
        out: dict = {}
        for s in self.stats:
            if s == "IsPhysicallyOrdered":
                out["physically_ordered"] = True
            elif isinstance(s, dict):
                (name, body), = s.items()
                out[{"RangeStat": "range", "CardinalityStat": "cardinality", "DensityStat": "density", "HistogramStat": "histogram"}.get(name, name)] = body
        return out


@dataclass
class TableSpec:
    name: str
    file_id: str
    columns: list[ColumnSpec]

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, TYPES[c.kind], False) for c in self.columns])


class Catalog:
    """DataFrames and specifications by table name."""

    def __init__(self, tables: dict[str, DataFrame] | None = None, specs: Iterable[TableSpec] = ()):
        self.tables, self.specs = dict(tables or {}), {s.name: s for s in specs}

    @classmethod
    def of_parquet(cls, spark: SparkSession, folder: str, names: Iterable[str] = TEST_TABLES) -> Catalog:
        """Tables ``<folder>/<name>.parquet``; each is opened when it is asked for."""
        out = cls()
        out.tables = _Lazy(spark, folder, tuple(names))
        return out

    def register(self, name: str, df: DataFrame, spec: TableSpec | None = None) -> None:
        self.tables[name] = df
        if spec:
            self.specs[name] = spec

    def table(self, name: str) -> DataFrame:
        from lathe.operators.relational import PlanError

        if name not in self.tables:
            raise PlanError(f"unknown table {name!r}")
        return self.tables[name]

    def column_statistics(self, column: str) -> dict | None:
        """Of the first table that has the column."""
        return next((c.facts() for s in self.specs.values() for c in s.columns if c.name == column), None)

    def range_of(self, table: str, column: str) -> tuple | None:
        """The least and greatest value of a table's column, if the catalog has them."""
        spec = self.specs.get(table)
        facts = next((c.facts() for c in spec.columns if c.name == column), {}) if spec else {}
        found = facts.get("range")
        return None if found is None else tuple(next(iter(found[k].values())) for k in ("lower_bound", "upper_bound"))

    def views(self) -> None:
        """Registers all tables as temporary views, for SQL beside the tree."""
        for name in list(self.tables):
            self.table(name).createOrReplaceTempView(name)

    def save(self, path: str) -> None:
        tables = [{"name": s.name, "file_id": s.file_id, "column_specs": [{"column_name": c.name, "data_type": c.kind, "stats": c.stats or None} for c in s.columns]} for s in self.specs.values()]
        Path(path).write_text(json.dumps({"table_specs": tables}, indent=1))

    @staticmethod
    def load_specs(path: str) -> list[TableSpec]:
        found = json.loads(Path(path).read_text())["table_specs"]
        return [TableSpec(t["name"], t["file_id"], [ColumnSpec(c["column_name"], c["data_type"], c.get("stats") or []) for c in t["column_specs"]]) for t in found]


class _Lazy(dict):
    def __init__(self, spark: SparkSession, folder: str, names: tuple[str, ...]):
        super().__init__()
        self._spark, self._folder, self._names = spark, folder, names

    def __contains__(self, name: object) -> bool:
        return name in self._names or super().__contains__(name)

    def __iter__(self):
        return iter(dict.fromkeys([*self._names, *super().__iter__()]))

    def __missing__(self, name: str) -> DataFrame:
        self[name] = found = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return found
