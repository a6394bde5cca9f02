"""Rows as text: each value followed by ``|``; floats with 15 significant digits and at least one decimal."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def float_text(x: float) -> str:
    """As C's ``%.15g``, with ``.0`` behind whole numbers; ``inf`` and ``nan`` plainly."""
    s = f"{x:.15g}"
    return s if any(c in s for c in ".e") or not math.isfinite(x) else f"{s}.0"


@F.pandas_udf(T.StringType())
def _float_texts(values: pd.Series) -> pd.Series:
    return values.map(float_text, na_action="ignore")


def value_text(column: Column, kind: T.DataType) -> Column:
    """A null is empty text."""
    text = _float_texts(column.cast("double")) if isinstance(kind, (T.FloatType, T.DoubleType)) else column.cast("string")
    return F.coalesce(text, F.lit(""))


def row_text(df: DataFrame) -> DataFrame:
    """One column ``value``: a row's text. The rows' order stays."""
    parts = [p for f in df.schema for p in (value_text(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType), F.lit("|"))]
    return df.select(F.concat(*parts).alias("value"))
