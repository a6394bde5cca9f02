"""Predicates as columns, by the types of both sides.

* A string never equals a number and has no order with one: EQ and the orderings are false, NE is true; with a null on
  either side all are null, as in SQL.
* A literal compared with a date or timestamp column is an ISO string; it is cast, not the column.
* ``semantics="spark"``: all else as Spark SQL does it (integers against 32-bit floats as doubles; NaN equals itself and is
  the largest value).
* ``semantics="reference"``: integers against 32-bit floats compare as 32-bit floats; NaN equals nothing and has no order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.plans.ir import Value

LITERAL_TYPES: dict[str, T.DataType] = {"I32": T.IntegerType(), "I64": T.LongType(), "F32": T.FloatType(), "F64": T.DoubleType(), "String": T.StringType()}
_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "EQ": lambda a, b: a == b,
    "NE": lambda a, b: a != b,
    "GT": lambda a, b: a > b,
    "GTE": lambda a, b: a >= b,
    "LT": lambda a, b: a < b,
    "LTE": lambda a, b: a <= b,
}
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def literal(value: Value) -> Column:
    return F.lit(value.value).cast(LITERAL_TYPES[value.kind])


def compared(left: Column, left_type: T.DataType, operator: str, right: Column, right_type: T.DataType, semantics: str = "spark") -> Column:
    """The predicate as a boolean column."""
    strings = [isinstance(t, T.StringType) for t in (left_type, right_type)]
    times = [isinstance(t, _TIMES) for t in (left_type, right_type)]
    if any(strings) and any(times):
        left, right = (left, right.cast(left_type)) if times[0] else (left.cast(right_type), right)
    elif strings[0] != strings[1]:
        return F.when(left.isNotNull() & right.isNotNull(), F.lit(operator == "NE"))
    if semantics == "reference":
        kinds = (left_type, right_type)
        if any(isinstance(t, T.FloatType) for t in kinds):
            left, right = (x.cast("float") if isinstance(t, _WHOLE) else x for x, t in zip((left, right), kinds, strict=True))
        test = _TESTS[operator](left, right)
        for x, t in zip((left, right), kinds, strict=True):
            if isinstance(t, (T.FloatType, T.DoubleType)):
                test = (test | F.isnan(x)) if operator == "NE" else (test & ~F.isnan(x))
        return test
    return _TESTS[operator](left, right)
