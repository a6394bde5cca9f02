"""Operator 1: byte-level BPE encoding and decoding by the tiktoken library and a local rank file.

A long text is first cut at boundaries that no match of the split pattern crosses, so ids equal those of the whole text
while the regular expression engine never sees more than a bounded piece (a single longer match stays whole). Decoding
joins the raw bytes of the ids; nothing is repaired, so any id sequence decodes.

Null and empty texts have no ids. Repeated rows give repeated rows; an empty table gives an empty table; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import arrow_map, small_batches, text_or_empty
from lathe.llm.texts import split_safely


class RankCodec:
    """tiktoken over a rank file (each line: a token's bytes in base64, and its rank)."""

    _made: dict[tuple[str, str], RankCodec] = {}

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str, pattern: str) -> RankCodec:
        """The one of this worker process."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def encode(self, text: str, limit: int = 1 << 16) -> np.ndarray:
        ids = [self.tokens.encode_to_numpy(part, disallowed_special=()) for part in split_safely(text, limit)]
        return (ids[0] if len(ids) == 1 else np.concatenate(ids)).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens.decode_bytes(ids.tolist())


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every whole text; ``path`` is a rank file that all executors have."""
    small_batches(docs.sparkSession)

    def rows(part: pa.RecordBatch) -> dict:
        codec = RankCodec.of(path, pattern)
        ids = [codec.encode(x) for x in part.column(1).to_pylist()]
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        return {"doc_id": part.column(0), "ids": pa.ListArray.from_arrays(ends, np.concatenate(ids))}

    return arrow_map(docs.select("doc_id", text_or_empty().alias("text")), rows, "doc_id long, ids array<int>", "text")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids, bytes binary: the raw bytes that the ids stand for (null ids: none)."""
    small_batches(encoded.sparkSession)

    def rows(part: pa.RecordBatch) -> dict:
        codec, ids = RankCodec.of(path, pattern), part.column(1)
        values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
        return {"doc_id": part.column(0), "ids": ids, "bytes": [codec.decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]}

    plain = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return arrow_map(plain, rows, "doc_id long, ids array<int>, bytes binary", "ids")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids (decimal, joined by commas) and of the bytes decoded from them."""
    back = decode_documents(encode_documents(docs, path, pattern), path, pattern)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
