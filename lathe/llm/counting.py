"""Counts of strings by class over a whole table."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import schema_of, small_batches

_COUNTS = "class string, unit string, n long"
#: Distinct strings that a task holds before it passes on its counts.
HELD = 200_000


def unit_counts(texts: DataFrame, units: Callable[[str], list[str]]) -> DataFrame:
    """class, unit, n from rows (class, text), summed in each task first. All are counted; none is left out."""
    small_batches(texts.sparkSession)
    fields = schema_of(_COUNTS)

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for label, counter in held.items():
            columns = ([label] * len(counter), list(counter), list(counter.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(label, Counter()).update(units(text))
            if sum(map(len, held.values())) > HELD:
                yield from rows(held)
                held = {}
        yield from rows(held)

    return texts.select("class", "text").mapInArrow(run, _COUNTS).groupBy("class", "unit").agg(F.sum("n").alias("n"))
