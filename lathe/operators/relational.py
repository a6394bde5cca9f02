"""The five operators on DataFrames. All stay in the JVM; Catalyst optimises across them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.compare import LITERAL_TYPES, compared, literal
from lathe.plans.ir import Predicate, SortKey
from lathe.sources.shared import shared_folder, written

#: Spark's hints for the join algorithms: sorted merge, hash over shuffled sides, hash over a broadcast side, nested loops.
JOIN_HINTS = ("merge", "shuffle_hash", "broadcast", "shuffle_replicate_nl")
#: A side is broadcast on demand only if Spark estimates it at no more bytes than this.
BROADCAST_LIMIT = 64 << 20
_LOW33 = (1 << 33) - 1


class PlanError(ValueError):
    """A query that doesn't fit its tables."""


def named(df: DataFrame, name: str) -> Column:
    """The one column of that name; names may hold dots."""
    found = df.columns.count(name)
    if found != 1:
        raise PlanError(f"{'ambiguous' if found else 'unknown'} column {name!r}; there are {df.columns}")
    return F.col("`" + name.replace("`", "``") + "`")


def filtered(df: DataFrame, predicates: Iterable[Predicate], semantics: str = "spark") -> DataFrame:
    """Rows for which all predicates hold."""
    types = {f.name: f.dataType for f in df.schema}
    for p in predicates:
        left = named(df, p.column)
        if p.value.kind == "Column":
            right, kind = named(df, p.value.value), types[p.value.value]
        else:
            right, kind = literal(p.value), LITERAL_TYPES[p.value.kind]
        df = df.filter(compared(left, types[p.column], p.operator, right, kind, semantics))
    return df


def projected(df: DataFrame, columns: Iterable[tuple[str, str]]) -> DataFrame:
    """Columns by (name, new name), in that order; a column may be taken more than once."""
    pairs = list(columns)
    if len({new for _, new in pairs}) != len(pairs):
        raise PlanError(f"two columns of one name in {[new for _, new in pairs]}")
    return df.select(*(named(df, old).alias(new) for old, new in pairs))


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size, from files and the plan; nothing runs."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def crossed(left: DataFrame, right: DataFrame, hint: str | None = None, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """All pairs of rows, left columns first. Filters above make it a join; ``hint`` then asks for an algorithm.

    A right side that is too large for ``broadcast`` is joined by hash over shuffled sides.
    """
    both = set(left.columns) & set(right.columns)
    if both:
        raise PlanError(f"both sides have columns {sorted(both)}; rename them by a projection")
    if hint is not None and hint not in JOIN_HINTS:
        raise PlanError(f"unknown join hint {hint!r}")
    if hint == "broadcast" and estimated_bytes(right) > broadcast_limit:
        hint = "shuffle_hash"
    return left.join(right.hint(hint) if hint else right)  # inner, not cross: Spark's runtime filters know inner joins alone


def sorted_by(df: DataFrame, keys: Iterable[SortKey]) -> DataFrame:
    """All rows in the order of the keys."""
    keys = list(keys)
    return df.orderBy(*(named(df, k.column).asc() if k.ascending else named(df, k.column).desc() for k in keys)) if keys else df


def placed(df: DataFrame, name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in a sorted table.

    The sorted rows are written with their partition and their place in it; the partitions' counts, one row each, are
    summed up ahead of them. So no task sees all rows, as it would in a window over the whole table.
    """
    rows = written(df.withColumn("__id", F.monotonically_increasing_id()), shared_folder(df.sparkSession))
    part = F.shiftright("__id", 33)
    counts, before, entries = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect(), 0, []
    for number, n in counts:
        entries.append((number, before))
        before += n
    starts = df.sparkSession.createDataFrame(entries, "__part long, __before long")
    out = rows.join(F.broadcast(starts), part == F.col("__part"))
    return out.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit(_LOW33)) + 1).drop("__id", "__part", "__before")
