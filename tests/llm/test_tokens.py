import base64
import hashlib
import shutil
import zlib

import numpy as np
import public_tokenizers as tokenizers_files
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lathe.llm import bpe, idfiles, packing
from lathe.llm.queries import PATTERN, QUERIES, RANKS, TOKENIZER
from lathe.llm.texts import LibraryEncoder, split_safely

with open(RANKS, "rb") as _lines:
    _ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, _lines)}
TIKTOKEN = tiktoken.Encoding("own", pat_str=tokenizers_files.PATTERN, mergeable_ranks=_ranks, special_tokens={})
LIBRARY = Tokenizer.from_file(TOKENIZER)

texts = st.text(st.one_of(st.sampled_from("ab'st 19.!\n\t\r é字 \x1c\x85😀"), st.characters()), max_size=300)


@settings(max_examples=300, deadline=None)
@given(texts, st.integers(1, 20))
def test_cuts_change_no_ids(text, limit):
    text = text.encode("utf-8", "ignore").decode()
    assert "".join(split_safely(text, limit)) == text
    codec = bpe.RankCodec.of(RANKS, PATTERN)
    ids = codec.encode(text, limit)
    assert ids.tolist() == TIKTOKEN.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=500, deadline=None)
@given(st.one_of(texts, st.lists(st.sampled_from(["a", "don't", " ", "\n", "'s", "B2", ".", "é", "!?", "_", "42", "<|endoftext|>", "<|", "endoftext", "|>"]), max_size=40).map("".join)))
def test_kept_matches_change_no_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    own = np.frombuffer(LibraryEncoder.of(TOKENIZER).encode(text), "<u4").tolist()
    assert own == LIBRARY.encode(text, add_special_tokens=False).ids


def test_matches_are_kept_and_forgotten():
    encoder = LibraryEncoder(TOKENIZER, keep=5)
    for text in ("one two three four five six\n\n  seven", "one  two 1\t\n ", "a\nb c's don't", "six seven eight é ¼ nine", "one two", "\n", " ", "", " a b", "\na b\nc", "a \nb", "a\n b"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_special_strings():
    """Text to tiktoken without special tokens; to the library, as it is called, one id."""
    text = "a<|endoftext|>b"
    assert bpe.RankCodec.of(RANKS, PATTERN).encode(text).tolist() == TIKTOKEN.encode_ordinary(text)
    assert np.frombuffer(LibraryEncoder.of(TOKENIZER).encode(text), "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    long = "word 12 " * 20_000 + text + " é" * 70_000
    assert np.frombuffer(LibraryEncoder.of(TOKENIZER).encode(long), "<u4").tolist() == LIBRARY.encode(long, add_special_tokens=False).ids


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_round_trip_of_odd_rows(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    want = sorted((r[0] or -1, len(i := TIKTOKEN.encode_ordinary(r[1] or "")), sha(",".join(map(str, i)).encode()), sha((r[1] or "").encode())) for r in rows)
    found = bpe.round_trip(odd, RANKS, PATTERN).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in found) == want
    assert bpe.round_trip(empty, RANKS, PATTERN).collect() == []


def test_query_round_trip(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    found = QUERIES["op1_byte_bpe"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.decoded_sha256 == sha((texts[r.doc_id] or "").encode())
        assert r.ids_sha256 == sha(",".join(map(str, TIKTOKEN.encode_ordinary(texts[r.doc_id] or ""))).encode())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=200), st.integers(8, 20))
def test_code_lengths(counts, limit):
    lengths = idfiles.code_lengths(np.asarray(counts), limit).astype(int)
    assert lengths.max() <= limit
    assert len(counts) == 1 or sum(2.0**-lengths) == 1
    import heapq  # an unlimited Huffman code's total, where it keeps the limit

    heap = [(c, 0) for c in counts]
    heapq.heapify(heap)
    total = deepest = 0
    while len(heap) > 1:
        (a, da), (b, db) = heapq.heappop(heap), heapq.heappop(heap)
        total, deepest = total + a + b, max(da, db) + 1
        heapq.heappush(heap, (a + b, deepest))
    if len(counts) > 1 and deepest <= limit:
        assert int((lengths * np.asarray(counts)).sum()) == total


def test_code_limit_too_small():
    with pytest.raises(ValueError, match="more than 2 bits"):
        idfiles.code_lengths(np.ones(5), 2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 60000), max_size=1200), st.integers(0, 600))
def test_code_round_trip(ids, split):
    ids = np.asarray(ids, np.int64)
    used, counts = np.unique(ids, return_counts=True)
    code = idfiles.HuffmanCode(used, idfiles.code_lengths(counts))
    if not len(ids):
        return
    split = min(split, len(ids) - 1)
    counts = np.asarray([n for n in (split, len(ids) - split) if n], np.int64)
    bits, sizes, marks = code.encode(ids, counts)
    starts = np.repeat(8 * (np.cumsum(sizes) - sizes), -(-counts // 256))
    stretches = np.concatenate([np.minimum(256, n - np.arange(0, n, 256)) for n in counts])
    assert code.decode(bits, marks + starts, stretches).tolist() == ids.tolist()
    firsts = np.cumsum(stretches) - stretches
    for at, n, first in zip(marks + starts, stretches, firsts, strict=True):  # each stretch alone
        assert code.decode(bits, np.asarray([at]), np.asarray([n])).tolist() == ids[first : first + n].tolist()


def encoded(text, end):
    return np.asarray([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end], "<u4").tobytes()


def check_files(rows, texts):
    want = sorted(((r[0] is not None, r[0] or 0, encoded(r[1], 2)) for r in texts), key=lambda x: x[:2])
    rows = sorted(rows, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in rows] == [x[:2] for x in want]
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in rows) == sorted((x[1], zlib.crc32(x[2])) for x in want)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert at == sum(len(x[2]) // 4 for x in want)


def test_id_files_of_odd_rows(spark, odd, empty, tmp_path):
    from pyspark.sql import functions as F

    for name, docs in (("odd", odd), ("empty", empty)):
        back = idfiles.through_files(docs, f"{tmp_path}/{name}", TOKENIZER, 2)
        check_files(back.withColumn("ids_crc32", F.crc32("ids")).collect(), docs.select("doc_id", "text").collect())


def test_query_id_files(spark, sf_dir):
    check_files(QUERIES["op2_huffman_ids"](spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())


def check_pack(rows, texts, length=1024):
    assert sorted(r.doc_id or 0 for r in rows if r.start == 0) == sorted(r[0] or 0 for r in texts)
    place = {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(place) == list(range(len(place)))
    for k, pieces in place.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == length or k == len(place) - 1 and at < length
    whole = {(r.sequence_id * length + r.offset - r.start, r.doc_id): [] for r in rows}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        whole[r.sequence_id * length + r.offset - r.start, r.doc_id].append(r)
    got = []
    for (_, doc), pieces in whole.items():
        data = b"".join(p.ids for p in pieces)
        assert sum(p.length for p in pieces) == pieces[0].doc_tokens == len(data) // 4
        assert all(p.ids_crc32 == zlib.crc32(p.ids) for p in pieces)
        got.append((doc or 0, data))
    assert sorted(got) == sorted((r[0] or 0, encoded(r[1], 0)) for r in texts)


def test_packing(spark, odd, empty, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for d in (odd, docs):
        check_pack(packing.pack(d, TOKENIZER).collect(), d.select("doc_id", "text").collect())
    assert packing.pack(empty, TOKENIZER).collect() == []
    assert QUERIES["op10_concat_and_cut"](spark, sf_dir).count() == packing.pack(docs, TOKENIZER).count()


def test_packing_bounds_what_its_workers_keep(spark, tmp_path):
    """Of 700,000 distinct words a worker keeps two generations at most, and batches stay small where files are read."""
    own = shutil.copy(TOKENIZER, tmp_path / "own.json")
    docs = spark.range(0, 700, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(0, 999), i -> concat('w', id * 1000 + i))) AS text")
    docs = docs.select("doc_id", F.translate("text", "0123456789", "abcdefghij").alias("text"))
    pieces = packing.pack(docs, str(own))
    assert pieces.where("start = 0").count() == 700
    assert spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == "512"

    def kept(batches):
        for _ in batches:
            many = [len(e.matches) + len(e.matches.before) for key, e in LibraryEncoder._made.items() if str(own) in key]
            yield pa.RecordBatch.from_pydict({"n": pa.array(many or [0], pa.int64())})

    most = max(r.n for _ in range(5) for r in spark.range(0, 40, 1, 8).mapInArrow(kept, "n long").collect())
    assert 0 < most < 2 * packing.KEEP + 2000
