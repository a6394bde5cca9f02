import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathe.llm import common, exact_dedup, near_dedup
from lathe.llm.queries import QUERIES
from tests.llm.conftest import prose, row

N = -(10**9)


def exact(rows, best):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    out = []
    for text, docs in groups.items():
        known = [d for d in docs if d is not None]
        keep = best(known) if known else None
        left = 1
        for d in docs:
            kept = d == keep and left > 0
            left -= kept
            out.append((N if d is None else d, N if keep is None else keep, len(docs), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((N if r.doc_id is None else r.doc_id, N if r.keep_id is None else r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize(("keep", "best"), [("smallest", min), ("largest", max)])
def test_exact_groups(odd, keep, best):
    assert got(exact_dedup.duplicate_groups(odd, keep)) == exact(odd.select("doc_id", "text").collect(), best)


def test_equal_digests_are_verified(odd):
    weak = lambda text: F.encode(F.length(text).cast("string"), "utf-8")
    assert got(exact_dedup.duplicate_groups(odd, digest=weak)) == exact(odd.select("doc_id", "text").collect(), min)


def test_exact_empty(empty):
    assert exact_dedup.duplicate_groups(empty).collect() == []
    assert exact_dedup.deduplicated(empty).collect() == []


def test_exact_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(QUERIES["op3_exact_dedup"](spark, sf_dir)) == exact(docs.select("doc_id", "text").collect(), max)


def test_exact_stage_keeps_columns(odd):
    left = exact_dedup.deduplicated(odd)
    assert left.columns == odd.columns
    assert sorted((N if r[0] is None else r[0]) for r in left.select("doc_id").collect()) == sorted(d for d, *_, kept, _ in exact(odd.select("doc_id", "text").collect(), min) if kept)


def test_index_in_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path), fanout=2)
    for i in range(5):
        rows = spark.createDataFrame([(bytes([i % 3]), 10 - i), (bytes([7]), 100 + i)], "digest binary, doc_id long")
        index.add(rows)
        assert sum(map(len, index.levels.values())) <= 3
    assert {bytes(r.digest): (r.keep_id, r.rows) for r in index.entries().collect()} == {b"\0": (7, 2), b"\1": (6, 2), b"\2": (8, 1), b"\7": (100, 5)}
    assert [r.keep_id for r in index.lookup(b"\7").collect()] == [100]


def brute_classes(rows, similarity=0.8):
    """Connected components over all pairs."""
    sets = [near_dedup.shingles(near_dedup.words_of(t or "")) for _, t in rows]
    words = [tuple(near_dedup.words_of(t or "")) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small and small >= similarity * large and (words[i] == words[j] or near_dedup.weighted_jaccard(sets[i], sets[j]) >= similarity):
                up[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[root(i)].append(N if doc is None else doc)
    return sorted(tuple(sorted(g)) for g in groups.values())


def found_classes(found, rows):
    by, alone = defaultdict(list), []
    for r in found:
        assert r.class_size >= 1
        (alone.append((N if r.doc_id is None else r.doc_id,)) if r.class_size == 1 else by[r.class_id].append(N if r.doc_id is None else r.doc_id))
    return sorted([*alone, *(tuple(sorted(g)) for g in by.values())])


def test_near_classes_of_odd_rows(odd, empty):
    rows = odd.select("doc_id", "text").collect()
    found = near_dedup.near_duplicates(odd).collect()
    assert found_classes(found, rows) == brute_classes(rows)
    classes = defaultdict(int)
    for r in found:
        classes[r.class_id, r.class_size if r.class_size > 1 else id(r)] += r.kept
    assert set(classes.values()) == {1}
    assert near_dedup.near_duplicates(empty).collect() == []
    left = near_dedup.deduplicated(odd)
    assert left.columns == odd.columns and left.count() == len(brute_classes(rows))


def test_near_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found_classes(QUERIES["op4_dart_minhash"](spark, sf_dir).collect(), rows) == brute_classes(rows)


@pytest.mark.parametrize("block", [3, 512])
def test_buckets_of_several_components(spark, block, monkeypatch):
    """Chains of near copies and a passage that many texts share, so that buckets hold several components."""
    rows, passage = [], prose(99, 150)
    for group in range(4):
        words = prose(group, 150).split()
        for step in range(12):  # each a little further from the first
            words[step * 11 : step * 11 + 2] = [f"new{group}{step}", "word"]
            rows.append(row(group * 100 + step, " ".join(words)))
    rows += [row(1000 + i, passage + " " + prose(500 + i, 30)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a0 string, a1 string, a2 string, a3 long, a4 long, a5 long, a6 long, a7 int, a8 string, a9 double, a10 boolean, a11 string")
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    found = near_dedup.near_duplicates(docs).collect()
    pairs = [(r[0], r[1]) for r in rows]
    assert found_classes(found, pairs) == brute_classes(pairs)


def test_links_that_signatures_underrate(spark):
    """Two texts of similarity 0.8 agree in 0.74 of the coordinates, and meet only in buckets whose first vertex is like neither."""
    core = prose(172, 268).rstrip(".").split()
    texts = [core[:n] + core[n + 30 :] for n in range(0, 239, 8)] + [core + [f"{end}172x{i}" for i in range(33)] for end in "ab"]
    rows = [(i, " ".join(words)) for i, words in enumerate(texts)]
    a, b = (near_dedup.shingles(near_dedup.words_of(text)) for _, text in rows[-2:])
    assert near_dedup.weighted_jaccard(a, b) == 0.8 and (near_dedup.signature(a, 384) == near_dedup.signature(b, 384)).mean() < 0.74
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert found_classes(found, rows) == brute_classes(rows)


def test_compared_in_pieces(monkeypatch):
    monkeypatch.setattr(near_dedup, "PIECE", 100)
    r = np.random.default_rng(2)
    sets = [np.sort(r.integers(0, 60, n).astype("<u4")) for n in r.integers(40, 90, 30)]
    size, every = np.array([len(x) for x in sets]), np.arange(30)
    fits = every[:, None] < every[None, :]
    links = list(near_dedup._joining([x.tobytes() for x in sets], size, every + 100, every, every, fits, 0.42))
    up = {v: {v} for v in range(30)}
    for v in range(30):
        for w in range(v):
            if near_dedup.weighted_jaccard(sets[v], sets[w]) >= 0.42 and up[v] is not up[w]:
                up[v] |= up[w]
                up |= dict.fromkeys(up[w], up[v])
    assert all(near_dedup.weighted_jaccard(sets[v], sets[w]) >= 0.42 and up[v] is up[w] for v, w in links)
    assert len(links) == 30 - len({id(x) for x in up.values()}) > 3


def test_components(spark, tmp_path):
    r = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {v: root(v) for a, b in edges if a != b for v in (a, b)}
    found = near_dedup.components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path))
    assert {x.v: x.comp for x in found.collect()} == want and found.count() == len(want)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    ids = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
    a, b = r.uniform(0.2, 3, len(ids)), r.uniform(0.2, 3, len(ids))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    same = (near_dedup.signature(ids, 4096, a) == near_dedup.signature(ids, 4096, b)).mean()
    assert abs(same - want) < 0.04
    counted = np.sort(np.repeat(ids, r.integers(1, 4, len(ids))))
    values, counts = np.unique(counted, return_counts=True)
    assert (near_dedup.signature(counted, 384) == near_dedup.signature(values, 384, counts.astype(float))).all()
    assert len(near_dedup.signature(np.zeros(0, np.uint64), 8)) == 0


def test_salted_join(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECES", 10)
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "a long, b long")
    sizes = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    names = sizes.select("a", (F.col("a") * 2).alias("twice")).where("a <> 6")
    for total in (300, 3000, 0):
        out = common.salted_join(rows, names, "a", sizes, total, "b")
        assert out.columns == ["a", "b", "twice"]
        assert sorted(map(tuple, out.collect())) == sorted((a, b, 2 * a) for a, b in rows.collect() if a != 6)
    none = rows.limit(0)
    assert common.salted_join(none, names, "a", sizes.limit(0), 0, "b").collect() == []
