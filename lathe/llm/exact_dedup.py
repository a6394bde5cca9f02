"""Operator 3: exact duplicates by a log-structured merge index of digests, in DataFrame operations only.

Rows go to memtables. A memtable combines rows of equal digest as they come and is flushed as a run: rows (digest, ids
that could stay, count) sorted by digest, in Parquet with Parquet's Bloom filters on the digest, so that a lookup skips
row groups without it. Each shard of the digest space keeps its own part of every run. ``fanout`` runs of one level
are merged into one run of the next (compaction), which keeps the winning identifier of each digest: the smallest, or the
largest if so asked. Digests with more than one row are hits. Their texts are then compared byte by byte: rows are grouped
by digest and text together, so texts that differ part even if their digests are equal.

All grouping is summed up before it is shuffled: a text that a third of all rows share costs one row a task.

Null text counts as empty; empty texts are equal. Null doc_ids come last: such a row stays only in a group without
others. Of rows repeated with equal doc_id and text, one is kept. A very long text moves only if its digest has several
rows. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import key_of, removed, retained, sized, staged, text_or_empty, workspace

_RUN = "digest binary, keep_id long, rows long"


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """The index: runs by level under a folder. ``add`` flushes one or more memtables; ``compact`` merges full levels."""

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", fanout: int = 4):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is smallest or largest")
        self.spark, self.path, self.fanout = spark, path, fanout
        self.winner = F.min if keep == "smallest" else F.max
        self.levels: dict[int, list[str]] = {}
        self._made = 0

    def _flush(self, rows: DataFrame, level: int) -> None:
        """Rows (run, digest, keep_id, rows) to sorted runs, all of them in one job."""
        self._made += 1
        path = f"{self.path}/level={level}/{self._made}"
        merged = rows.groupBy("run", "digest").agg(self.winner("keep_id").alias("keep_id"), F.sum("rows").alias("rows"))
        options = {"compression": "zstd", "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        merged.sortWithinPartitions("run", "digest").write.options(**options).partitionBy("run").parquet(path)
        found = self.spark.read.schema(f"{_RUN}, run int").parquet(path).select("run").distinct().collect()  # at most ``runs`` rows
        self.levels.setdefault(level, []).extend(f"{path}/run={r[0]}" for r in sorted(found))

    def add(self, rows: DataFrame, memtables: int = 1) -> None:
        """Rows (digest, doc_id), dealt to so many memtables by their ids."""
        run = F.pmod(F.xxhash64("doc_id"), F.lit(memtables)).cast("int") if memtables > 1 else F.lit(0)
        self._flush(rows.select(run.alias("run"), "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("rows")), 0)
        self.compact()

    def compact(self, whole: bool = False) -> None:
        """Merges levels of ``fanout`` runs, or all runs into one."""
        level = 0
        while level <= max(self.levels, default=0):
            own = self.levels.get(level, [])
            if len(own) >= self.fanout:
                self._flush(self._read(own).withColumn("run", F.lit(0)), level + 1)
                self.levels[level] = []
            level += 1
        if whole and sum(map(len, self.levels.values())) > 1:
            every = [r for runs in self.levels.values() for r in runs]
            self._flush(self._read(every).withColumn("run", F.lit(0)), level)
            self.levels = {level: self.levels[level][-1:]}

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(_RUN).parquet(*runs) if runs else self.spark.createDataFrame([], _RUN)

    def entries(self) -> DataFrame:
        """digest, keep_id, rows, one row a digest."""
        self.compact(whole=True)
        return self._read([r for runs in self.levels.values() for r in runs])

    def lookup(self, digest: bytes) -> DataFrame:
        """The entries of one digest in any run; Bloom filters and sorted row groups leave little to read."""
        return self._read([r for runs in self.levels.values() for r in runs]).where(F.col("digest") == F.lit(digest))


def duplicate_groups(docs: DataFrame, keep: str = "smallest", memtables: int = 4, digest=text_digest, path: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, digest: one row for each row of ``docs``."""
    spark = docs.sparkSession
    path = path or workspace(spark)
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", digest(F.col("text")))
    index = DigestIndex(spark, f"{path}/index", keep)
    index.add(texts.select("digest", "doc_id"), memtables)
    hits = staged(index.entries().where("rows > 1").select("digest"), f"{path}/hits")

    # Byte verification: equal digests are told apart by their texts.
    same = texts.join(sized(hits, 48), "digest", "left_semi").groupBy("digest", "text")
    verified = same.agg(index.winner("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("rows"))
    verified = verified.select("digest", F.unhex(F.sha2("text", 256)).alias("text_sha256"), "keep_id", "rows")
    verified = staged(verified, f"{path}/verified")
    for name in ("index", "hits"):
        removed(spark, f"{path}/{name}")

    # Rows repeated with one id and text are one row with a count until the end.
    rows = texts.select("doc_id", "digest", F.unhex(F.sha2("text", 256)).alias("text_sha256"))
    rows = rows.groupBy("doc_id", "digest", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    found = rows.join(sized(verified, 96), ["digest", "text_sha256"], "left")
    found = found.withColumn("group_size", F.coalesce("rows", "n")).withColumn("keep_id", F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
    return found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    path = workspace(docs.sparkSession)
    decided = duplicate_groups(docs, keep, path=path)
    key = key_of(F.col("text_sha256"))
    counted = staged(decided.where("group_size > 1").groupBy(key.alias("key")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), f"{path}/decided")
    return retained(docs, counted.where("not kept"), counted.where("n > 1 and kept"))
