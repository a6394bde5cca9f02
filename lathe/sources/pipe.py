"""Pipe-delimited files with schema files beside them.

``<table>.schema`` has two lines, names and types, split by ``|``, with or without a last ``|``. ``<table>.csv`` has one row
a line, without quotes or a header. Rows that don't fit the schema stop the query; nothing is trimmed or dropped.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.text import row_text
from lathe.plans.catalog import SCHEMA_TOKENS, TYPES, Catalog, ColumnSpec, TableSpec


class SchemaError(ValueError):
    """A schema file that is not well formed."""


def _fields(line: str) -> list[str]:
    parts = line.rstrip("\r\n").split("|")
    return parts[:-1] if parts and parts[-1] == "" else parts


def parse_schema(text: str, table: str) -> TableSpec:
    """Types beyond the last name are ignored; a name without a type is an error."""
    rows = text.split("\n")
    if len(rows) < 2:
        raise SchemaError(f"{table}: two lines are needed")
    names, kinds = _fields(rows[0]), [k.strip().upper() for k in _fields(rows[1])]
    if len(names) > len(kinds):
        raise SchemaError(f"{table}: {len(names)} names, {len(kinds)} types")
    unknown = [k for k in kinds if k not in SCHEMA_TOKENS]
    if unknown:
        raise SchemaError(f"{table}: unknown types {unknown}")
    return TableSpec(table, table, [ColumnSpec(n.strip(), SCHEMA_TOKENS[k]) for n, k in zip(names, kinds, strict=False)])


def schema_text(schema: T.StructType) -> str:
    tokens = {v: k for k, v in SCHEMA_TOKENS.items()}
    kinds = {t: tokens[n] for n, t in TYPES.items()}
    return "".join(f"{f.name}|" for f in schema) + "\n" + "".join(f"{kinds[f.dataType]}|" for f in schema) + "\n"


def read_pipe(spark: SparkSession, path: str, spec: TableSpec) -> DataFrame:
    """A file, or a folder of files. Every line has the columns' values, and may end with ``|``."""
    n = len(spec.columns)
    parts = F.split("value", r"\|", -1)
    whole = (F.size("parts") == n) | ((F.size("parts") == n + 1) & (F.get("parts", F.lit(n)) == ""))
    rows = spark.read.text(path).select("value", parts.alias("parts"))
    wrong = F.raise_error(F.concat(F.lit(f"{spec.name}: a row without {n} values: "), F.col("value")))
    rows = rows.select(F.when(whole, F.col("parts")).otherwise(wrong.cast("array<string>")).alias("parts"))
    return rows.select(*(F.coalesce(F.get("parts", F.lit(i)).cast(TYPES[c.kind]), F.lit("" if c.kind == "String" else None).cast(TYPES[c.kind])).alias(c.name) for i, c in enumerate(spec.columns)))


def write_pipe(df: DataFrame, path: str) -> None:
    """Text files in a folder, in the rows' order by file name."""
    row_text(df).write.mode("overwrite").text(path)


def discover(spark: SparkSession, folder: str) -> Catalog:
    """All ``*.csv`` with a ``.schema`` beside them; others are left out."""
    out = Catalog()
    for path in sorted(Path(folder).glob("*.csv")):
        if (own := path.with_suffix(".schema")).exists():
            spec = parse_schema(own.read_text(), path.stem)
            out.register(spec.name, read_pipe(spark, str(path), spec), spec)
    return out
