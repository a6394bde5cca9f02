"""Operator 10: packing by concatenating and cutting.

Pass one encodes each text, adds the end id and notes how many ids of its partition stand before it; the rows are staged.
The sums of the partitions (one row for each) give each partition's place in one long run of ids. Pass two cuts the run
into windows of ``length`` ids. Each row knows its place, so pass two cuts rows anywhere and in any order; where a window's
edge falls in a document, each side is a piece. Only the last window may be short, so at most length - 1 ids are padding.

Nothing is shuffled. A very long text is one row of ids before it is cut. A null text counts as empty and holds just the end id. Repeated rows are all packed; an empty table
has no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import schema_of, small_batches, staged, steps, text_or_empty, workspace
from lathe.llm.texts import LibraryEncoder

#: Matches that an encoder keeps in a generation: a third of the usual, as workers here stand beside full JVM heaps.
KEEP = 200_000
_ENCODED = "part int, before long, doc_id long, ids binary"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def encode_in_place(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """part, before (ids of the part before the row), doc_id, ids (unsigned 32-bit little-endian, with the end id)."""
    small_batches(docs.sparkSession)
    end, fields = np.asarray([end_id], "<u4").tobytes(), schema_of(_ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = LibraryEncoder.of(path, KEEP), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in steps(batch, 1):
                ids = [encoder.encode(x) + end for x in rows.column(1).to_pylist()]
                ends = before + np.cumsum([len(x) // 4 for x in ids])
                starts = np.concatenate([[before], ends[:-1]])
                before = int(ends[-1])
                columns = ([part] * len(ids), starts, rows.column(0), ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, _ENCODED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, path: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""
    spark = docs.sparkSession
    encoded = staged(encode_in_place(docs, tokenizer, end_id), f"{path or workspace(spark)}/encoded")
    totals = encoded.groupBy("part").agg(F.max(F.col("before") + F.octet_length("ids") / 4).cast("long")).collect()  # one row a partition
    parts = sorted((r[0], r[1]) for r in totals)
    places = dict(zip((p for p, _ in parts), np.cumsum([0, *(n for _, n in parts)]).tolist(), strict=False))
    fields = schema_of(_PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in steps(batch, 3):
                made: list[tuple] = []
                for part, before, doc, ids in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                    place, total, at = places[part] + before, len(ids) // 4, 0
                    while at < total:
                        sequence, offset = divmod(place + at, length)
                        n = min(length - offset, total - at)
                        own = ids[4 * at : 4 * (at + n)]
                        made.append((doc, at, n, zlib.crc32(own), total, sequence, offset, own))
                        at += n
                columns = zip(*made, strict=True) if made else ((),) * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=fields)

    return encoded.mapInArrow(run, _PIECE)
