"""Operator 4: near-duplicate classes by DartMinHash signatures, banding, and verified links.

A document is a weighted set: its shingles of five words (lower-cased runs of word characters; fewer words are one
shingle), each with its count as weight. The region of an element of weight w is [0, w) x [0, inf) in weight and rank.
Darts are thrown into it by hashing: each unit of weight has its own stream of darts whose ranks rise by exponential
steps, ``k`` a unit of rank on average, each with a hashed coordinate of 0..k-1. A document of total weight n throws those
of rank up to (ln k + 4) / n, so the work is about n + k ln k and long documents throw few darts an element; the few
documents with an empty coordinate throw further. The earliest dart of each coordinate is the signature: two documents
agree in a coordinate with the probability of their weighted Jaccard similarity.

``bands`` bands of ``rows`` coordinates are joined. A pair of similarity 0.8 meets in a band with probability
1 - (1 - 0.8^8)^48 > 0.9998. Each met pair is a candidate; a link is a candidate whose exact weighted Jaccard similarity
(of 32-bit shingle prints) is at least ``similarity``. Classes are the connected components of links. No pair of one
component needs a check, so:

1. texts with equal word sequences are one vertex;
2. every vertex of a bucket is checked against the bucket's first vertex, and components are formed;
3. buckets that hold several components are searched whole, block by block: a task compares two blocks of some hundred
   vertices, and checks every pair of different components exactly. Links that it finds join components in the task at
   once, so it gives fewer links than it has vertices.

So no pair is emitted because of a shared bucket alone, no bucket is in one task, and nothing is capped. Buckets of equal
members are searched once. In an open bucket only vertices outside its largest component are compared with all others: a
block of those meets each block, so a bucket that one component nearly fills costs little more than its rows.

Equal word sequences are found twice over: in a task, where only the first row gets a signature, and by a join, whose
links need no check. Large tables are joined by sorted merges at every size. Joins by pivot, open bucket, text and class
are salted: a key with more than a thousandth of the rows is dealt to several tasks. The join of all rows with their
buckets, the largest, leaves this to adaptive execution, as salting took more memory. ``n_links`` counts the links that
were verified on the way: they connect the class, but pairs within a component were not looked at.

Very long texts have as many shingles as words; blocks are cut by shingles too, so a task holds a bounded number of them
unless a single text has more. Null texts and texts without words are alone in their class. A class is named by its smallest doc_id (null: none known),
which is the one kept; of repeated rows one is kept. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm.common import arrow_map, key_of, removed, retained, salted_join, schema_of, small_batches, staged, steps, text_or_empty, workspace

_WORD = re.compile(r"\w+")
_U = np.uint64
_STEP, _MUL1, _MUL2 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Vertices of a bucket, about, that one task compares with as many others, and the shingles that they may have.
BLOCK = 512
BLOCK_SHINGLES = 4_000_000
#: Shingles of each side that a task compares at a time.
PIECE = 500_000
_LOW24 = _U((1 << 24) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _MUL1
    x = (x ^ (x >> _U(27))) * _MUL2
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_hashes = _WordHashes()


def forget_words() -> None:
    """Frees what a worker process keeps of words."""
    _hashes.clear()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the word shingles, repeated ones too."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        total = (total + h[i : i + n]) * _MUL1
        total ^= total >> _U(29)
    return np.sort(mixed(total))


def signature(elements: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The earliest dart of each of k coordinates: of sorted hashes, where a repeated one counts its repeats as weight, or
    of distinct hashes with real weights. Empty for no elements."""
    if weights is None:
        firsts = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]])) if len(elements) else np.zeros(0, np.int64)
        unit = np.arange(len(elements)) - np.repeat(firsts, np.diff(np.append(firsts, len(elements))))
        seeds, width = mixed(elements + unit.astype(np.uint64) * _STEP), None
        total = float(len(elements))
    else:
        units = np.ceil(weights).astype(np.int64)
        unit = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
        seeds = mixed(np.repeat(elements, units) + unit.astype(np.uint64) * _STEP)
        width, total = np.minimum(1.0, np.repeat(weights, units) - unit), float(weights.sum())
    if not len(seeds) or total <= 0:
        return np.zeros(0, np.uint64)
    reach = (math.log(k) + 4) / total
    while True:
        best = np.full(k, np.iinfo(np.uint64).max, np.uint64)
        alive, rank, step = np.arange(len(seeds)), np.zeros(len(seeds)), 0
        while len(alive):
            many = max(1, min(64, int(k * (reach - rank.min())) + 1))
            turn = (np.arange(step + 1, step + many + 1, dtype=np.uint64) * _MUL2)[None, :]
            dart = mixed(seeds[alive][:, None] ^ turn)
            ranks = rank[:, None] + np.cumsum(-np.log(((dart >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53), axis=1) / k
            thrown = ranks <= reach
            if width is not None:  # darts beside the region fall away
                inside = (mixed(dart ^ _MUL1) >> _U(11)).astype(np.float64) * 2.0**-53 < width[alive][:, None]
                kept = thrown & inside
            else:
                kept = thrown
            other = mixed(dart[kept] + _STEP)
            key = (ranks[kept].view(np.uint64) & ~_LOW24) | (other & _LOW24)
            np.minimum.at(best, ((other >> _U(32)) % _U(k)).astype(np.int64), key)
            go = thrown[:, -1]
            alive, rank, step = alive[go], ranks[go, -1], step + many
        if best.max() != np.iinfo(np.uint64).max:
            return best
        reach *= 2


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ too."""
    h = np.arange(1, bands + 1, dtype=np.uint64) * _STEP
    for part in sketch.reshape(bands, rows).T if len(sketch) else ():
        h = mixed(h ^ part)
    return h.view(np.int64) if len(sketch) else np.zeros(0, np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted multisets."""
    if not len(a) or not len(b):
        return 0.0
    values = np.concatenate([a, b])
    order = np.argsort(values, kind="stable")
    values = values[order]
    firsts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    of_a = np.add.reduceat((order < len(a)).astype(np.int64), firsts)
    of_all = np.diff(np.append(firsts, len(values)))
    both = int(np.minimum(of_a, of_all - of_a).sum())
    return both / (len(values) - both)


_SIGNED = "rid long, doc_id long, sha binary, words binary, n long, keys array<long>, prints binary"


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """rid, doc_id, sha (of the text), words (digest of the word sequence; null: none), n, keys, prints for each row.

    Only a task's first row of each word sequence has keys and prints.
    """
    small_batches(docs.sparkSession)
    text, fields = text_or_empty(), schema_of(_SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes | None] = {None}
        for batch in batches:
            for part in steps(batch, 3):
                made: list[list] = [[], [], [], []]
                for x in part.column(3).to_pylist():
                    words = words_of(x)
                    digest = hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).digest() if words else None
                    row: tuple = (digest, 0, [], None)
                    if digest not in seen:
                        seen.add(digest)
                        found = shingles(words)
                        row = (digest, len(found), band_hashes(signature(found, k), bands, rows), np.sort((found >> _U(32)).astype("<u4")).tobytes())
                    for column, value in zip(made, row, strict=True):
                        column.append(value)
                columns = [part.column(0), part.column(1), part.column(2), *(pa.array(c, f.type) for c, f in zip(made, [*fields][3:], strict=True))]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)
        forget_words()

    rows_in = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    return rows_in.mapInArrow(run, _SIGNED)


def components(edges: DataFrame, path: str) -> DataFrame:
    """v, comp (the smallest vertex of its component) of an undirected graph (a, b), by alternating large and small stars."""
    now, turn, before = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{path}/0"), 0, None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())
        before, turn = mark, turn + 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = salted_join(both, least.select("a", "m"), "a", least, 2 * mark[0], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, f"{path}/{turn}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = salted_join(large, least.select("a", "m"), "a", least, large.count(), "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        now = staged(small, f"{path}/{turn}")
        removed(now.sparkSession, f"{path}/{turn - 1}")
        removed(now.sparkSession, f"{path}/{turn}-large")


def _linked(pairs: DataFrame, prints: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity is enough; any b may be in many pairs."""
    small_batches(pairs.sparkSession)
    held = prints.select("rid", "prints")
    near = pairs.join(held.toDF("a", "p").hint("merge"), "a")
    near = salted_join(near, held.toDF("b", "q"), "b", pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")), pairs.count(), "a").select("a", "b", "p", "q")

    def made(part: pa.RecordBatch) -> dict:
        sides = (part.column(i).to_pylist() for i in (2, 3))
        s = [weighted_jaccard(np.frombuffer(p, "<u4"), np.frombuffer(q, "<u4")) for p, q in zip(*sides, strict=True)]
        return {"a": part.column(0), "b": part.column(1), "s": s}

    return arrow_map(near, made, "a long, b long, s double", "p").where(F.col("s") >= similarity)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of rows with equal first three columns."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]) if held else table
        ids = np.stack([held.column(i).to_numpy() for i in range(3)])
        edges = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1).tolist()]
        for first, last in zip(edges, edges[1:], strict=False):
            yield held.slice(first, last - first)
        held = held.slice(edges[-1])
    if held and held.num_rows:
        yield held


def _elements(prints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the elements of sorted multisets, where each repeat counts as another element, and where each set starts."""
    values = np.frombuffer(b"".join(prints), "<u4").astype(np.uint64)
    starts = np.cumsum([0, *(len(p) // 4 for p in prints[:-1])])
    new = np.concatenate([[True], values[1:] != values[:-1]])
    new[starts] = True
    firsts = np.flatnonzero(new)
    repeat = np.arange(len(values)) - np.repeat(firsts, np.diff(np.append(firsts, len(values))))
    return np.unique(values << _U(32) | repeat.astype(np.uint64), return_inverse=True)[1], starts


def _pieces(at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Cuts places where the sum of their sizes passes multiples of ``PIECE``."""
    return np.split(at, np.flatnonzero(np.diff(np.cumsum(size[at]) // PIECE)) + 1) if len(at) else []


def _joining(prints: list[bytes], size: np.ndarray, comp: np.ndarray, x: np.ndarray, y: np.ndarray, fits: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links of x and y that join components: each pair that fits is checked exactly unless links before it joined its ends."""
    label = np.unique(comp, return_inverse=True)[1]
    for left in _pieces(np.flatnonzero(fits.any(1)), size[x]):
        for right in _pieces(np.flatnonzero(fits.any(0)), size[y]):
            ids, starts = _elements([prints[v] for v in (*x[left], *y[right])])
            ends, others = np.append(starts, len(ids)), ids[starts[len(left)] :]
            held = np.zeros(ids.max() + 1, np.bool_)
            for n, row in enumerate(left):
                v = x[row]
                wanted = fits[row, right] & (label[y[right]] != label[v])
                if not wanted.any():
                    continue
                own = ids[ends[n] : ends[n + 1]]
                held[own] = True
                both = np.add.reduceat(held[others], starts[len(left) :] - starts[len(left)], dtype=np.int64)
                held[own] = False
                for w in y[right[wanted & (both / (size[v] + size[y[right]] - both) >= similarity)]]:
                    if label[v] != label[w]:
                        label[label == label[w]] = label[v]
                        yield v, w


def _searched(rows: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between components that meet in a bucket: enough of them to join all that links in the bucket join.

    Rows: h (bucket), main (its largest component), n_main and s_main (vertices of that, and their shingles), n_rest and
    s_rest (of the others), rid, comp, size (shingles), prints. Both kinds of vertices are dealt to blocks, the others'
    first. Each block of the others is one group with each block, and with itself.
    """
    count = lambda kind: F.greatest(F.ceil(F.col(f"n_{kind}") / BLOCK), F.ceil(F.col(f"s_{kind}") / BLOCK_SHINGLES), F.lit(1)).cast("int")
    own = rows.withColumn("m", count("main")).withColumn("r", count("rest"))
    is_main, place = F.col("comp") == F.col("main"), F.xxhash64("rid")
    own = own.withColumn("block", F.when(is_main, F.col("r") + F.pmod(place, "m")).otherwise(F.pmod(place, "r")).cast("int"))
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.when(is_main, F.col("r")).otherwise(F.col("r") + F.col("m")) - 1)).alias("other"))
    own = own.select("h", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "comp", "size", "prints")

    def near(group: pa.Table) -> list[tuple[int, int]]:
        rid, comp, block, size = (group.column(c).to_numpy() for c in ("rid", "comp", "block", "size"))
        i, j = (group.column(c)[0].as_py() for c in ("i", "j"))
        order = np.argsort(rid)
        x = order[block[order] == i]
        y = x if i == j else order[block[order] == j]
        if not len(x) or not len(y):
            return []
        fits = comp[x][:, None] != comp[y][None, :]
        fits &= np.minimum(size[x][:, None], size[y][None, :]) >= similarity * np.maximum(size[x][:, None], size[y][None, :])
        if i == j:
            fits &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
        if not fits.any():
            return []
        return [(rid[v], rid[w]) for v, w in _joining(group.column("prints").to_pylist(), size, comp, x, y, fits, similarity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if links := near(group):
                yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()) for ends in zip(*links, strict=True)], ["a", "b"])

    links = own.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, "a long, b long")
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _met(every: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows (h, rid, pivot) of buckets with several vertices, and rid, size, prints of those vertices.

    Both steps shuffle 16 bytes for each row and band; prints move once.
    """
    firsts = every.where(F.size("keys") > 0)
    keyed = firsts.select("rid", F.explode("keys").alias("h"))
    buckets = staged(keyed.groupBy("h").agg(F.min("rid").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "pivot"), f"{path}/buckets")
    shared = staged(keyed.join(buckets.hint("merge"), "h"), f"{path}/shared")  # of two tables as they are: Spark splits hot keys
    removed(every.sparkSession, f"{path}/buckets")
    members = shared.select("rid").distinct()
    held = firsts.select("rid", F.col("n").alias("size"), "prints").join(members.hint("merge"), "rid", "left_semi")
    return shared, staged(held, f"{path}/prints")


def _open_rows(shared: DataFrame, prints: DataFrame, comp: DataFrame, path: str) -> DataFrame:
    """The rows of ``_searched`` without prints: of buckets with several components, one bucket of those with equal members."""
    nodes = prints.select("rid", "size").join(comp.select(F.col("v").alias("rid"), "comp").hint("merge"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    labelled = staged(shared.select("h", "rid").join(nodes.hint("merge"), "rid"), f"{path}/labelled")
    x, y = F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")
    groups = labelled.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), x, y)
    whole = groups.groupBy("h").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("comps"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.max(F.struct("n", "comp", "s")).alias("top")
    ).where("comps > 1")
    once = whole.groupBy("n", "x", "y").agg(F.min(F.struct("h", "s", "top")).alias("one"))
    once = once.select(
        "one.h", "n", F.col("one.top.comp").alias("main"), F.col("one.top.n").alias("n_main"), F.col("one.top.s").alias("s_main"),
        (F.col("n") - F.col("one.top.n")).alias("n_rest"), (F.col("one.s") - F.col("one.top.s")).alias("s_rest"),
    )
    once = staged(once, f"{path}/open_buckets")
    rows = staged(salted_join(labelled, once.drop("n"), "h", once.select("h", "n"), labelled.count(), "rid"), f"{path}/open")
    removed(rows.sparkSession, f"{path}/labelled")
    return rows


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 48, rows: int = 8, path: str | None = None) -> DataFrame:
    """doc_id, class_id, class_size, n_links (of the row's text: links that were verified), kept, sha: one row for each row."""
    spark: SparkSession = docs.sparkSession
    path, k = path or workspace(spark), bands * rows
    work = f"{path}/work"
    every = staged(signatures(docs, k, bands, rows), f"{work}/signatures")
    named = every.select("rid", "doc_id", "sha", F.coalesce("words", F.encode(F.concat(F.lit("-"), F.col("rid").cast("string")), "utf-8")).alias("words"))
    vertices = staged(named.groupBy("words").agg(F.min("rid").alias("vertex"), F.count(F.lit(1)).alias("size")), f"{work}/vertices")
    shared, prints = _met(every, work)

    met = staged(shared.where("rid <> pivot").select(F.col("rid").alias("a"), F.col("pivot").alias("b")).distinct(), f"{work}/met")
    size, many = prints.select("rid", "size"), met.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    near = salted_join(met.join(size.toDF("a", "n_a").hint("merge"), "a"), size.toDF("b", "n_b"), "b", many, met.count(), "a")
    pairs = staged(near.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).select("a", "b"), f"{work}/pairs")
    links = staged(_linked(pairs, prints, similarity).select("a", "b"), f"{work}/links")
    same = every.where(F.size("keys") > 0).select("rid", "words").join(vertices.hint("merge"), "words").where("rid <> vertex").select(F.col("rid").alias("a"), F.col("vertex").alias("b"))
    same = staged(same, f"{work}/same")
    comp = components(links.unionByName(same), f"{work}/components")

    open_rows = _open_rows(shared, prints, comp, work)
    removed(spark, f"{work}/shared")
    if not open_rows.isEmpty():
        found = staged(_searched(open_rows.join(prints.drop("size").hint("merge"), "rid"), similarity).distinct(), f"{work}/links_open")
        links = links.unionByName(found)
        comp = components(links.unionByName(same), f"{work}/components_open")
    out = _classes(named, vertices, links, comp, path)
    removed(spark, work)
    return out


def _classes(named: DataFrame, vertices: DataFrame, links: DataFrame, comp: DataFrame, path: str) -> DataFrame:
    """The rows of ``near_duplicates``. They are staged; nothing else is read later."""
    ends = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    ends = ends.join(named.select("rid", "words"), "rid").groupBy("words").agg(F.sum("n_links").alias("n_links"))
    whole = vertices.join(comp.select(F.col("v").alias("vertex"), "comp"), "vertex", "left").withColumn("comp", F.coalesce("comp", "vertex"))
    whole = whole.join(ends, "words", "left").select("words", "comp", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    total = named.count()
    rows = staged(salted_join(named, whole, "words", vertices.withColumnRenamed("size", "n"), total, "rid").select("rid", "doc_id", "sha", "comp", "n_links"), f"{path}/rows")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return salted_join(rows, first, "comp", first.select("comp", F.col("class_size").alias("n")), total, "rid").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", "n_links", (F.col("rid") == F.col("first.rid")).alias("kept"), "sha"
    )


def deduplicated(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    path = workspace(docs.sparkSession)
    decided = near_duplicates(docs, similarity, path=path)
    key = key_of(F.lower(F.hex("sha"))).alias("key")
    counted = staged(decided.where("class_size > 1").groupBy(key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), f"{path}/decided")
    removed(docs.sparkSession, f"{path}/rows")
    return retained(docs, counted.where("not kept"), counted.where("n > 1 and kept"))
