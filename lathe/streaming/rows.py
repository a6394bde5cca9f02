"""Results as lines, partition by partition; the driver never holds more than one partition."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from lathe.functions.text import row_text


def lines(df: DataFrame) -> Iterator[str]:
    """The rows' text in their order."""
    for row in row_text(df).toLocalIterator():
        yield row.value


def framed(df: DataFrame) -> Iterator[str]:
    """The lines between ``validate`` and ``!``."""
    yield "validate"
    yield from lines(df)
    yield "!"
