"""Files of fixed-size blocks: packed rows from the block's start, the number of rows in its last two bytes.

Numbers are little-endian; strings are UTF-8 and end with a zero byte, so they hold none. A row never spans blocks.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lathe.plans.catalog import TableSpec

BLOCK_SIZE = 4096
_NUMBERS = {T.IntegerType(): "<i", T.LongType(): "<q", T.FloatType(): "<f", T.DoubleType(): "<d"}


def decode_block(block: bytes, schema: T.StructType) -> list[list]:
    """The columns of a block's rows: numbers alone by one view of the block, else runs of numbers and strings row by row."""
    (rows,) = struct.unpack_from("<H", block, len(block) - 2)
    kinds = [_NUMBERS.get(f.dataType) for f in schema]
    if all(kinds):
        packed = np.frombuffer(block, np.dtype([(str(i), kind) for i, kind in enumerate(kinds)]), rows)
        return [packed[str(i)] for i in range(len(kinds))]
    runs: list = []  # a packed run of numbers, or None for a string
    for kind in kinds:
        if kind and runs and runs[-1]:
            runs[-1] += kind[1]
        else:
            runs.append(kind)
    plan = [r and struct.Struct(r) for r in runs]
    at, made = 0, []
    for _ in range(rows):
        row: list = []
        for packed in plan:
            if packed:
                row += packed.unpack_from(block, at)
                at += packed.size
            else:
                end = block.index(0, at)
                row.append(block[at:end].decode())
                at = end + 1
        made.append(row)
    return [list(c) for c in zip(*made, strict=True)] if made else [[] for _ in kinds]


def encode_rows(rows: Iterator[tuple], schema: T.StructType, size: int = BLOCK_SIZE) -> Iterator[bytes]:
    kinds = [_NUMBERS.get(f.dataType) for f in schema]
    held, used, count = [], 0, 0

    def block() -> bytes:
        return b"".join(held).ljust(size - 2, b"\0") + struct.pack("<H", count)

    for row in rows:
        parts = []
        for x, kind in zip(row, kinds, strict=True):
            if not kind and "\0" in x:
                raise ValueError("a string with a zero byte")
            parts.append(struct.pack(kind, x) if kind else x.encode() + b"\0")
        one = b"".join(parts)
        if len(one) > size - 2:
            raise ValueError(f"a row of {len(one)} bytes in blocks of {size}")
        if used + len(one) > size - 2 or count == 0xFFFF:
            yield block()
            held, used, count = [], 0, 0
        held.append(one)
        used, count = used + len(one), count + 1
    if count:
        yield block()


def read_blocks(spark: SparkSession, path: str, spec: TableSpec, size: int = BLOCK_SIZE) -> DataFrame:
    """Reads block files; this is the one place that needs an RDD, for records of a fixed size."""
    schema = spec.schema()
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(decode_block(block, schema), arrow, strict=True)], schema=arrow)

    raw = spark.createDataFrame(spark.sparkContext.binaryRecords(path, size).map(lambda b: (b,)), "block binary")
    return raw.mapInArrow(run, schema)


def to_blocks(df: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """One column ``block``; each partition fills its own."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for block in encode_rows(rows, schema, size):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["block"])

    return df.mapInArrow(run, "block binary")


def write_blocks(df: DataFrame, path: str, size: int = BLOCK_SIZE) -> None:
    """To a folder with one file for each partition, written by the tasks; all executors must see the folder.

    A file gets its name when it is whole, so a task that runs again leaves one file.
    """
    os.makedirs(path, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, count = f"{path}/part-{task.partitionId():05d}", 0
        own = f"{path}/.{task.taskAttemptId()}"
        with open(own, "wb") as out:
            for batch in batches:
                for block in batch.column(0).to_pylist():
                    out.write(block)
                    count += 1
        os.replace(own, name) if count else os.remove(own)
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], ["blocks"])

    to_blocks(df, size).mapInArrow(run, "blocks long").agg({"blocks": "sum"}).collect()
