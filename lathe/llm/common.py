"""Shared folders, staged tables and Arrow batches of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.sources.shared import shared_folder

#: Bytes of text that one step of a Python operator handles, unless a single text is longer.
STEP_BYTES = 4 << 20
#: A side of a join is broadcast only when its rows were counted and need no more than this.
BROADCAST_BYTES = 8 << 20
#: A key with more than this part of a join's rows is dealt to several tasks.
PIECES = 1000


def workspace(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share.

    It lies in the session's ``spark.checkpoint.dir``. Only a local session may do without that setting.
    """
    return shared_folder(spark)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (``__`` in a name stands for a dot) that hold within the block only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, path: str) -> DataFrame:
    """Writes a table and reads it back: cuts the lineage, and survives lost executors.

    The shuffle files of the write go at its end, not when the driver next collects garbage.
    """
    with settings(df.sparkSession, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, reads: bool = True) -> None:
    """Arrow batches by bytes and by few rows, and with ``reads`` files read by few rows too, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 * STEP_BYTES))
    if reads:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A staged table, marked for broadcast if its counted rows fit the limit; else Spark shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def salted_join(rows: DataFrame, groups: DataFrame, key: str, sizes: DataFrame, total: int, by: str) -> DataFrame:
    """Inner join of many rows with one row for each key, where any key may hold a large part of the rows.

    ``sizes`` has each key's number of rows in ``n``, of ``total`` in all. Rows of keys with more than 1 / ``PIECES`` of
    the total are dealt by ``by`` to pieces of about that many, and these keys' one row goes to each piece. Fewer than
    ``PIECES`` keys can be so large: this bounds what is broadcast.
    """
    piece = max(1, total // PIECES)
    hot = F.broadcast(sizes.where(F.col("n") > piece).select(key, F.ceil(F.col("n") / piece).cast("int").alias("__pieces")))
    pieces = F.coalesce("__pieces", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(by), pieces).cast("int")).drop("__pieces")
    right = groups.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("__pieces")
    return left.join(right, [key, "__salt"]).drop("__salt")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key() -> Column:
    """Equal for rows of equal doc_id and text (null text: empty), and only for those."""
    return key_of(F.sha2(text_or_empty(), 256))


def key_of(text_sha256: Column) -> Column:
    """``row_key`` from the text's digest in lowercase hex."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), text_sha256), 256))


def steps(batch: pa.RecordBatch, column: int, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about ``limit`` bytes (or list elements) in the column; a longer value stands alone."""
    first = size = 0
    values = batch.column(column)
    sizes = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if i > first and size + n > limit:
            yield batch.slice(first, i - first)
            first, size = i, 0
        size += n
    if first < batch.num_rows:
        yield batch.slice(first)


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], dict], schema: str, by: str, limit: int = STEP_BYTES) -> DataFrame:
    """Applies ``rows`` to parts of about ``limit`` bytes of column ``by``; it returns the new columns by name."""
    at, fields = df.columns.index(by), schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, at, limit):
                made = rows(part)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def unnamed(df: DataFrame) -> DataFrame:
    """The same columns by number, for Arrow functions: these can't take every name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def free_name(taken: list[str], name: str = "key") -> str:
    """A column name that is none of those taken, in any letter case."""
    lower = {t.lower() for t in taken}
    while name in lower:
        name += "_"
    return name


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def retained(docs: DataFrame, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't dropped, and one of each key's rows.

    ``dropped`` and ``repeated`` are staged tables of ``row_key()`` in a column ``key``. Repeated rows are rows of equal
    doc_id and text; where their other columns differ, any one of them stays. No name of a column clashes.
    """
    names, key = docs.columns, free_name(docs.columns)
    keyed = docs.withColumn(key, row_key())
    left = keyed.join(sized(dropped.select(F.col("key").alias(key)), 64), key, "left_anti")
    if not repeated.isEmpty():
        again = sized(repeated.select(F.col("key").alias(key)), 64)
        left = left.join(again, key, "left_anti").unionByName(left.join(again, key, "left_semi").dropDuplicates([key]))
    return left.select(*(F.col(f"`{n}`") for n in names))
