"""Statistics of a table's columns: range, distinct values, density, physical order, histogram.

Ranges, orders and histograms are of columns whose values have an order that a catalog can hold: numbers, strings, dates,
times. ``analyze`` leaves them out for others (arrays, maps, structures, binary); maps have no distinct counts either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lathe.operators.relational import placed
from lathe.plans.catalog import ColumnSpec, TableSpec, type_name

EXACT_LIMIT = 10_000
BUCKETS = 10
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_ORDERED = (T.NumericType, T.StringType, *_TIMES)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _one_row(df: DataFrame, columns: list[str], one) -> DataFrame:
    """All aggregates of all columns in one row and one pass; ``one`` maps a column to named aggregates."""
    return df.agg(*(a.alias(f"{i}_{k}") for i, c in enumerate(columns) for k, a in one(quoted(c)).items()))


def _rows(df: DataFrame, columns: list[str], one) -> DataFrame:
    """A row for each column, where the aggregates have one type in all of them."""
    keys = list(one(F.lit(None)))
    entries = [F.struct(F.lit(c).alias("column_name"), *(F.col(f"{i}_{k}").alias(k) for k in keys)) for i, c in enumerate(columns)]
    return _one_row(df, columns, one).select(F.inline(F.array(*entries)))


def bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """(least, greatest) value of each column in the column's own type; nulls if it has no values."""
    if not columns:
        return {}
    found = _one_row(df, columns, lambda c: {"least": F.min(c), "most": F.max(c)}).first()
    return {c: (found[f"{i}_least"], found[f"{i}_most"]) for i, c in enumerate(columns)}


def ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, lower_bound, upper_bound as text: whole numbers and times lose nothing, fractions have all their digits."""
    return _rows(df, columns, lambda c: {"lower_bound": F.min(c).cast("string"), "upper_bound": F.max(c).cast("string")})


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, cardinality: exact counts of distinct values, one pass for each column.

    One aggregate over all columns would copy each row for every column before the shuffle.
    """
    each = [df.agg(F.lit(c).alias("column_name"), F.count_distinct(quoted(c)).alias("cardinality")) for c in columns]
    return reduce(DataFrame.unionByName, each)


def approx_distinct(df: DataFrame, columns: list[str], error: float = 0.0173) -> DataFrame:
    """column_name, cardinality: by a sketch of fixed size, with this relative standard deviation."""
    return _rows(df, columns, lambda c: {"cardinality": F.approx_count_distinct(c, error)})


def density(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, density: distinct values by rows, at most 1."""
    return _rows(df, columns, lambda c: {"density": F.least(F.lit(1.0), F.try_divide(F.count_distinct(c).cast("double"), F.count(F.lit(1))))})


def _ordered_within(values: pa.Array) -> bool:
    """No value is less than the one before it; nulls are passed over."""
    values = values.drop_null()
    return len(values) < 2 or not pc.any(pc.less(values[1:], values[:-1])).as_py()


def physical_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, physically_ordered: no value is less than the one before it in its file, files by path; nulls are passed over.

    For a table read from Parquet files. Arrow compares each batch with itself shifted by a row. Batches become stretches
    with their ends; these are summed up by file in Spark, and files by the driver's one row for each column.
    """
    schema = T.StructType([T.StructField(f"c{i}", df.schema[c].dataType) for i, c in enumerate(columns)])
    plain = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"), *(quoted(c).alias(f.name) for c, f in zip(columns, schema, strict=True)))
    found = [f"{kind}{i}" for i in range(len(columns)) for kind in ("ok", "head", "tail")]
    kinds = [t for f in schema for t in (T.BooleanType(), f.dataType, f.dataType)]
    made = T.StructType([T.StructField("path", T.StringType()), T.StructField("first", T.LongType()), *map(T.StructField, found, kinds)])
    fields = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, row = batch.column(0), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(row) != 1) | np.asarray(pc.not_equal(path[1:], path[:-1])).astype(bool)) + 1 if len(row) > 1 else []
            for a, b in zip([0, *cuts], [*cuts, len(row)], strict=True):
                if b > a:
                    out: list = [path[a], int(row[a])]
                    for i in range(2, batch.num_columns):
                        values = batch.column(i)[a:b].drop_null()
                        out += [_ordered_within(values), values[0] if len(values) else None, values[-1] if len(values) else None]
                    arrays = [pa.array([x.as_py() if isinstance(x, pa.Scalar) else x], f.type) for x, f in zip(out, fields, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    def step(i: int, row: str):
        """Of one stretch or file, as what the fold below takes up."""
        return F.struct(F.col(row).alias("at"), F.col(f"ok{i}").alias("ok"), F.col(f"head{i}").alias("head"), F.col(f"tail{i}").alias("tail"))

    def folded(i: int):
        """Stretches in order: all are in order, and none begins below the last value before it."""
        kind = schema[i].dataType.simpleString()
        start = F.struct(F.lit(True).alias("ok"), F.lit(None).cast(kind).alias("head"), F.lit(None).cast(kind).alias("tail"))
        follow = lambda a, x: F.struct(
            (a["ok"] & x["ok"] & ~F.coalesce(x["head"] < a["tail"], F.lit(False))).alias("ok"),
            F.coalesce(a["head"], x["head"]).alias("head"), F.coalesce(x["tail"], a["tail"]).alias("tail"),
        )
        return F.aggregate(F.array_sort(F.collect_list(step(i, at))), start, follow)

    at = "first"
    files = plain.mapInArrow(run, made).groupBy("path").agg(*(folded(i).alias(f"f{i}") for i in range(len(columns))))
    files = files.select("path", *(F.col(f"f{i}.{part}").alias(f"{name}{i}") for i in range(len(columns)) for part, name in (("ok", "ok"), ("head", "head"), ("tail", "tail"))))
    at = "path"
    whole = files.agg(*(folded(i)["ok"].alias(f"f{i}") for i in range(len(columns))))
    return whole.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"f{i}").alias("physically_ordered")) for i, c in enumerate(columns)))))


def sample(df: DataFrame, rows: int = 10_000, seed: int = 0) -> DataFrame:
    """Exactly so many random rows, or all of a smaller table: those with the least hashed random numbers (a top-k, no sort)."""
    return df.withColumn("__order", F.rand(seed)).orderBy("__order").limit(rows).drop("__order")


def _marks(values: DataFrame, buckets: int, accuracy: int) -> list:
    """The exact last value of each bucket but the greatest, ascending, each once; of one column ``place`` without nulls.

    With n rows the i-th is at rank ceil(i * n / buckets). A sketch guesses values at and around these ranks, and rows are
    counted at each guess and between two. A rank between two guesses is found by sorting the rows between them: with few rows
    none, else some 2 / ``accuracy`` of them for each mark. However bad the guesses are, they cost only time.
    """
    shares = {min(1.0, max(0.0, i / buckets + d / accuracy)) for i in range(1, buckets) for d in (-2, 0, 2)}
    total, found = values.agg(F.count("place"), F.percentile_approx("place", sorted(shares), accuracy)).first() if shares else (0, [])
    if not total:
        return []
    order = lambda x: (x != x, 0 if x != x else x)  # noqa: E731 - NaN is the greatest, as in Spark
    guesses = [{order(x): x for x in found if x is not None}[k] for k in sorted({order(x) for x in found if x is not None})]
    place = F.col("place")
    slot = reduce(lambda a, x: a + (place > F.lit(x)).cast("int") + (place >= F.lit(x)).cast("int"), guesses, F.lit(0))
    marks, between, wanted, before, inner = [], [], [], 0, 0
    ranks = [-(-i * total // buckets) for i in range(1, buckets)]
    for at, n in sorted(values.groupBy(slot.alias("slot")).count().collect()):  # two rows for each guess at most
        own = [r - before for r in ranks if before < r <= before + n]
        if own and at % 2:
            marks.append(guesses[at // 2])
        elif own:
            between.append(at)
            wanted += [inner + r for r in own]
            inner += n
        before += n
    if wanted:
        rows = placed(values.where(slot.isin(*between)).orderBy("place"), "rank")
        marks += [r[0] for r in rows.where(F.col("rank").isin(*wanted)).select("place").collect()]
    return [{order(x): x for x in marks}[k] for k in sorted({order(x) for x in marks})]


def histogram(df: DataFrame, column: str, buckets: int = BUCKETS, accuracy: int = 100_000) -> DataFrame:
    """bucket, lower_bound, upper_bound, frequency: at most so many buckets of like numbers of rows.

    Bounds are exact percentiles at every size; ``accuracy`` is that of the sketch that they are sought with. Equal values
    share a bucket; nulls are in none. Rows are counted by bucket where they lie; only sums are shuffled. Strings go by the
    number that their first seven bytes make, which keeps their order; those with equal beginnings share a bucket.
    """
    c = quoted(column)
    kind = df.schema[column].dataType
    place = c
    if isinstance(kind, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 7)), 14, "0")
        place = F.conv(head, 16, 10).cast("long")
    elif isinstance(kind, _TIMES):
        place = F.unix_micros(c.cast("timestamp_ltz"))
    marks = _marks(df.where(c.isNotNull()).select(place.alias("place")), buckets, accuracy)
    bucket = reduce(lambda a, m: a + (place > F.lit(m)).cast("int"), marks, F.lit(0))
    rows = df.where(c.isNotNull()).groupBy(bucket.alias("bucket"))
    return rows.agg(F.min(c).alias("lower_bound"), F.max(c).alias("upper_bound"), F.count(F.lit(1)).alias("frequency"))


def plain_value(x):
    """A value as JSON has it: times in ISO form."""
    return x if x is None or isinstance(x, (bool, int, float, str)) else x.isoformat() if hasattr(x, "isoformat") else float(x)


def analyze(df: DataFrame, name: str) -> TableSpec:
    """A table's specification with all statistics, for a catalog file."""
    columns = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    orderly = [f.name for f in df.schema if isinstance(f.dataType, _ORDERED)]
    numeric = [f.name for f in df.schema if isinstance(f.dataType, _ORDERED) and not isinstance(f.dataType, T.StringType)]
    least_most = bounds(df, numeric)
    many = {r[0]: r[1] for r in approx_distinct(df, columns).collect()} if columns else {}
    exact = {r[0]: r[1] for r in cardinality(df, small).collect()} if (small := [c for c in columns if many[c] <= EXACT_LIMIT]) else {}
    ordered = {r[0]: r[1] for r in physical_order(df, orderly).collect()} if orderly else {}
    total, out = df.count(), []
    for f in df.schema:
        kind = type_name(f.dataType)
        stats: list = ["IsPhysicallyOrdered"] if ordered.get(f.name) and total else []
        low, high = least_most.get(f.name, (None, None))
        if low is not None:
            stats.append({"RangeStat": {"lower_bound": {kind: plain_value(low)}, "upper_bound": {kind: plain_value(high)}}})
        if f.name in many:
            n = exact.get(f.name, many[f.name])
            stats += [{"CardinalityStat": n}, {"DensityStat": min(1.0, n / total) if total else 0.0}]
            if f.name in numeric or f.name in orderly and n <= 50:
                rows = histogram(df, f.name).orderBy("lower_bound").collect()
                stats.append({"HistogramStat": {"frequency_points": [[{"lower_bound": {kind: plain_value(r[1])}, "upper_bound": {kind: plain_value(r[2])}}, r[3]] for r in rows]}})
        out.append(ColumnSpec(f.name, kind, stats))
    return TableSpec(name, name, out)
