"""Operator 2: files of token ids, coded by a canonical length-limited Huffman code of the ids' counts in all documents.

A file set is a folder of three Parquet tables, so that any store that Spark writes to will do:

* ``codebook``: id, length. The code is canonical: codes ascend by length, then by id.
* ``blocks``: part, block, start (ids before the block in its part), doc_ids, doc_tokens, checkpoints, bits. A block holds
  whole documents. Each document's bit string begins on a byte; ``checkpoints`` has the bit offset in the block of each
  document's first id and of every 256th id after it. So any block, and any stretch between checkpoints, decodes alone.
* ``parts``: part, start (ids in all parts before it). Parts ascend by doc_id.

Codes have at most 18 bits (a parameter), found by package-merge, so one table of 2**18 entries decodes an id a step; all
stretches of a block advance together, as numpy vectors.

Rows are written in ascending doc_id order, null doc_ids first; rows of equal doc_id by a hash of their text. A null text
counts as empty and holds just the end id. A very long text is one document in one block. Repeated rows are all written; an
empty table gives tables without rows; other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import arrow_map, removed, schema_of, small_batches, staged, steps, text_or_empty
from lathe.llm.texts import LibraryEncoder

STRETCH = 256
BLOCK_IDS = 1 << 18
#: Bounds of what the driver holds: parts are larger than 32 MB only beyond so many, and so many rows are sampled for their bounds.
MOST_PARTS = 50_000
SAMPLED = 400_000


def code_lengths(counts: np.ndarray, limit: int = 20) -> np.ndarray:
    """Bits of each symbol's code by package-merge: the least total for these counts with no code over ``limit`` bits."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.uint8)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need codes of more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.float64)[order]
    items, levels = leaves, []
    for _ in range(limit - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        items = both[at]
        levels.append(at < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    lengths[:take] += 1
    out = np.empty(n, np.uint8)
    out[order] = lengths
    return out


class HuffmanCode:
    """Codes by id from (id, length) alone, and the table that decodes them."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.most = int(self.lengths[-1]) if len(ids) else 1
        spans = np.left_shift(1, self.most - self.lengths)
        firsts = np.cumsum(spans) - spans
        top = int(self.ids.max()) + 1 if len(ids) else 0
        self.code_of, self.length_of = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code_of[self.ids] = (firsts >> (self.most - self.lengths)).astype(np.uint64)
        self.length_of[self.ids] = self.lengths
        self._table = None

    def encode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bit strings of texts with ``counts`` ids (none is empty), one behind the other, each from its first byte's highest
        bit; the bytes of each; and the bit offset in its text of every 256th id of each."""
        if not len(ids):
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths, codes = self.length_of[ids], self.code_of[ids]
        ends = np.cumsum(lengths)
        firsts = np.cumsum(counts) - counts
        before = ends[firsts] - lengths[firsts]
        sizes = (np.diff(np.append(before, ends[-1])) + 7) // 8
        starts = 8 * (np.cumsum(sizes) - sizes)
        at = ends - lengths + np.repeat(starts - before, counts)
        word, room = at >> 6, 64 - (at & 63) - lengths
        words = np.zeros((int(sizes.sum()) >> 3) + 2, np.uint64)
        over = np.flatnonzero(room < 0)
        own = codes << (room & 63).astype(np.uint64)
        own[over] = codes[over] >> (-room[over]).astype(np.uint64)
        edges = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[edges]] = np.bitwise_or.reduceat(own, edges)
        words[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        stretches = -(-counts // STRETCH)
        nth = np.arange(stretches.sum()) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        marks = at[np.repeat(firsts, stretches) + STRETCH * nth] - np.repeat(starts, stretches)
        return words.astype(">u8").tobytes()[: int(sizes.sum())], sizes, marks

    def decode(self, bits: bytes, checkpoints: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of stretches that begin at ``checkpoints`` and hold ``counts`` ids each."""
        if self._table is None:  # for each string of ``most`` bits the id that begins it, and in the low byte its length
            spans = np.left_shift(1, self.most - self.lengths)
            self._table = np.zeros(1 << self.most, np.uint32)
            self._table[: spans.sum()] = np.repeat(self.ids << 8 | self.lengths, spans)
        plain = np.frombuffer(bits + bytes(4), np.uint8).astype(np.uint32)
        four = plain[:-3] << 24 | plain[1:-2] << 16 | plain[2:-1] << 8 | plain[3:]  # 32 bits from each byte on
        order = np.argsort(-counts, kind="stable")
        left, at = counts[order], checkpoints[order].astype(np.int64)
        most = int(left[0]) if len(left) else 0
        alive = np.searchsorted(-left, -np.arange(most), side="left")
        made = np.zeros((most, len(order)), np.uint32)
        for i, n in enumerate(alive.tolist()):
            here = at[:n]
            found = self._table[(four[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - self.most)]
            made[i, :n] = found
            here += found & 255
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return (made >> 8).T[back][np.arange(most)[None, :] < counts[:, None]]


_ENCODED = "doc_id long, tie long, ids binary, counts binary"


def encode_texts(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, tie (a hash of the text), ids: each text's ids and the end id, as unsigned 32-bit little-endian bytes.

    Each task adds one row with null ids: ``counts`` has how often each id occurs in its rows, as 64-bit integers.
    """
    small_batches(docs.sparkSession, reads=False)
    end, fields = np.asarray([end_id], "<u4").tobytes(), schema_of(_ENCODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = LibraryEncoder.of(path), np.zeros(0, np.int64)
        for batch in batches:
            for part in steps(batch, 2):
                ids = [encoder.encode(x) + end for x in part.column(2).to_pylist()]
                seen = np.bincount(np.frombuffer(b"".join(ids), "<u4"))
                if len(seen) > len(total):
                    seen, total = total, seen
                total[: len(seen)] += seen
                columns = (part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(list(columns), schema=fields)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, None, total.tobytes()), fields, strict=True)], schema=fields)

    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64(text).alias("tie"), text.alias("text")).mapInArrow(run, _ENCODED)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The used ids of a task's ``counts``, and how often each occurs."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for value in batch.column(0):
            seen = np.frombuffer(value.as_py(), np.int64).copy()
            if len(seen) > len(total):
                seen, total = total, seen
            total[: len(seen)] += seen
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])


_BLOCK = "part int, block int, start long, doc_ids array<long>, doc_tokens array<long>, checkpoints array<long>, bits binary"


def _blocks(block_ids: int):
    fields = schema_of(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, count, held = None, 0, 0, 0, []

        def made() -> pa.RecordBatch:
            sizes = [len(x[2]) for x in held]
            firsts = np.cumsum([0, *sizes[:-1]]) * 8
            at = np.concatenate([np.frombuffer(x[3], "<i8") + first for x, first in zip(held, firsts, strict=True)])
            row = [part, block, start, [x[0] for x in held], [x[1] for x in held], at, b"".join(x[2] for x in held)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, fields, strict=True)], schema=fields)

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (own != part or count >= block_ids):
                    yield made()
                    block, start, count, held = block + 1, start + count, 0, []
                if own != part:
                    part, block, start = own, 0, 0
                held.append(row)
                count += row[1]
        if held:
            yield made()

    return run


def _place(doc_id: int | None, tie: int) -> tuple:
    return (doc_id is not None, doc_id or 0, tie)


def _bounds(encoded: DataFrame, parts: int) -> list[tuple]:
    """The least places of all parts but the first, from some 60 hashed rows a part; fewer where that makes over ``SAMPLED``."""
    each = max(4, min(60, SAMPLED // parts))
    keys = encoded.select("doc_id", "tie")
    rate = max(1, keys.count() // (each * parts))
    some = keys.where(F.pmod(F.xxhash64("tie", "doc_id"), F.lit(rate)) == 0).distinct().limit(4 * each * parts)
    places = sorted(_place(*r) for r in some.collect())
    return [places[i * len(places) // parts] for i in range(1, parts)] if places else []


def write_id_files(encoded: DataFrame, path: str, limit: int = 18, block_ids: int = BLOCK_IDS) -> None:
    """Writes the rows of ``encode_texts`` as a file set in ascending doc_id order. It reads them twice or more, so stage them."""
    spark = encoded.sparkSession
    small_batches(spark, reads=False)
    counts = encoded.where("counts is not null").select("counts").mapInArrow(_summed, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    encoded = encoded.where("ids is not null").select("doc_id", "tie", "ids")
    found = counts.toPandas().sort_values("id")  # at most one row for each id of the vocabulary
    ids, lengths = found["id"].to_numpy(np.int64), code_lengths(found["n"].to_numpy(), limit)
    spark.createDataFrame(list(zip(ids.tolist(), map(int, lengths), strict=True)), "id int, length int").coalesce(1).write.parquet(f"{path}/codebook")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, int((found["n"].to_numpy() * lengths).sum() >> 28)))
    bounds = _bounds(encoded, parts)
    shared = spark.sparkContext.broadcast((ids, lengths))

    def rows(part: pa.RecordBatch) -> dict:
        code, texts = _code(shared), part.column(2).to_pylist()
        counts = np.asarray([len(x) // 4 for x in texts], np.int64)
        bits, sizes, marks = code.encode(np.frombuffer(b"".join(texts), "<u4"), counts)
        ends, mark_ends, marks = np.cumsum(sizes), 8 * np.cumsum(-(-counts // STRETCH)), marks.astype("<i8").tobytes()
        places = map(_place, part.column(0).to_pylist(), part.column(1).to_pylist())
        return {
            "part": [bisect_right(bounds, x) for x in places],
            "doc_id": part.column(0), "tie": part.column(1), "n": counts,
            "bits": [bits[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)],
            "at": [marks[a:b] for a, b in zip([0, *mark_ends.tolist()], mark_ends.tolist(), strict=False)],
        }

    coded = arrow_map(encoded, rows, "part int, doc_id long, tie long, n long, bits binary, at binary", "ids", 1 << 19)
    ordered = coded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "tie").select("part", "doc_id", "n", "bits", "at")
    ordered.mapInArrow(_blocks(block_ids), _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    sums = spark.read.parquet(f"{path}/blocks").select("part", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = sorted(tuple(r) for r in sums.groupBy("part").agg(F.sum("n")).collect())  # one row for each partition
    starts = np.cumsum([0, *(n for _, n in totals)]).tolist()
    spark.createDataFrame([(p, s) for (p, _), s in zip(totals, starts, strict=False)], "part int, start long").coalesce(1).write.parquet(f"{path}/parts")


_last: list = [b"", None]


def _code(shared) -> HuffmanCode:
    """The code of a broadcast codebook; a worker process keeps the last one."""
    ids, lengths = shared.value
    key = ids.tobytes() + lengths.tobytes()
    if key != _last[0]:
        _last[:] = [key, HuffmanCode(ids, lengths)]
    return _last[1]


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids binary (unsigned 32-bit little-endian)."""
    small_batches(spark, reads=False)
    book = spark.read.parquet(f"{path}/codebook").toPandas().sort_values("id")
    starts = {r[0]: r[1] for r in spark.read.parquet(f"{path}/parts").collect()}
    shared = spark.sparkContext.broadcast((book["id"].to_numpy(np.int64), book["length"].to_numpy(np.uint8)))
    fields = schema_of("doc_id long, start long, n_tokens long, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _code(shared)
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.asarray(row["doc_tokens"], np.int64)
                stretches = [np.minimum(STRETCH, n - np.arange(0, n, STRETCH)) for n in counts.tolist()]
                ids = code.decode(row["bits"], np.asarray(row["checkpoints"]), np.concatenate(stretches)).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                first = starts[row["part"]] + row["start"]
                texts = [ids[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((row["doc_ids"], ends - counts + first, counts, texts), fields, strict=True)], schema=fields)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def through_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes ``docs``, writes them to a file set in ``path`` and reads it back."""
    encoded = staged(encode_texts(docs, tokenizer, end_id), f"{path}/encoded")
    write_id_files(encoded, f"{path}/files")
    removed(docs.sparkSession, f"{path}/encoded")
    return read_id_files(docs.sparkSession, f"{path}/files")
