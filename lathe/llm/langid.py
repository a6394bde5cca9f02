"""Operator 8: language by words first, with backoff to character n-grams.

The model is learned from labelled texts: how often each language has each word, and each n-gram of 1 to 4 characters of
its words (with marks for their ends). All strings of all texts make the model, however rare: it is two tables that grow
with the input. A word that the model knows scores its log frequency in each language (one that a language hasn't seen
counts there as a tenth). An unseen word scores by the mean of its n-grams of 4 characters that the model knows; if it knows
none, by those of 3, and so on; if it knows none at all, 0 in every language. A text's score in a language is the sum of its
words' scores by the square root of their number; the highest wins, of equal ones the first language by name. ``score`` is
the winner's share of the exponentials: 1 is certain, 1 by the number of languages is a guess.

Words with at least 1 in 500,000 of all learned words are few enough to go to all tasks, and are summed up where the text
is. The other words of a text are joined with the model's tables; each distinct one is looked up once. This split decides
where a word is scored, not how: scores are whole numbers of 2**-20, less the first language's, so their sums are the same
in any order and results don't depend on the split.

A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned. Rows with a
null text or language teach nothing. A very long text's words are counted at once, then it has a row for each distinct rare
word. Repeated rows give repeated rows; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import free_name, removed, row_key, salted_join, schema_of, small_batches, staged, steps, workspace
from lathe.llm.counting import unit_counts

_WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
#: The least share of all learned words that makes a word go to all tasks: at most its inverse are so frequent.
SHARE = 2e-6
#: Scores are whole numbers of this part of 1.
SCALE = 1 << 20
#: What a string counts in a language that hasn't seen it.
UNSEEN = 0.1
_GRAM_ROW = "class string, gram string, n long"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def gram_counts(words: DataFrame) -> DataFrame:
    """class, gram, n: the n-grams of counted words (class, unit, n). ``_`` marks both ends of a word.

    Only the longest n-grams are counted word by word, up to and over the word's end; their beginnings are the shorter.
    """
    fields, n = schema_of(_GRAM_ROW), LONGEST

    def made(held: dict[str, dict[str, int]]) -> Iterator[pa.RecordBatch]:
        for label, longest in held.items():
            grams: Counter = Counter()
            for gram, times in longest.items():
                gram = gram.rstrip("\0")
                for k in range(1, len(gram) + 1):
                    grams[gram[:k]] += times
            columns = ([label] * len(grams), list(grams), list(grams.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        for batch in batches:
            for label, word, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                longest = held.setdefault(label, {})
                ends = f"_{word}_\0\0\0"
                for i in range(len(word) + 2):
                    gram = ends[i : i + n]
                    longest[gram] = longest.get(gram, 0) + times
            if sum(map(len, held.values())) > 200_000:
                yield from made(held)
                held = {}
        yield from made(held)

    return words.select("class", "unit", "n").mapInArrow(run, _GRAM_ROW).groupBy("class", "gram").agg(F.sum("n").alias("n"))


@dataclass
class LanguageModel:
    """Languages by name, and tables of scores, words and grams: unit, s (one number a language), n (how often in all)."""

    languages: list[str]
    words: DataFrame
    grams: DataFrame
    total: int


def _by_language(counts: DataFrame, unit: str, sums: Column, languages: list[str]) -> DataFrame:
    """unit, s, n from rows (class, unit, n); ``sums`` has each language's total."""
    own = [F.sum(F.when(F.col("class") == x, F.col("n")).otherwise(0)) for x in languages]
    found = counts.groupBy(F.col(unit).alias("unit")).agg(F.sum("n").alias("n"), F.array(*own).alias("own"))
    return found.select("unit", F.zip_with("own", sums, lambda n, t: F.log((n + F.lit(UNSEEN)) / t)).alias("s"), "n")


def _whole(scores: Column) -> Column:
    """Logs as whole numbers, less the first."""
    return F.transform(scores, lambda x: F.round((x - scores[0]) * SCALE).cast("long"))


def learn(docs: DataFrame, path: str | None = None) -> LanguageModel:
    """From all rows (text, lang) where neither is null. The tables are staged."""
    path = path or workspace(docs.sparkSession)
    rows = docs.where("text is not null and lang is not null").select(F.col("lang").alias("class"), "text")
    words = staged(unit_counts(rows, words_of), f"{path}/words")
    grams = staged(gram_counts(words), f"{path}/grams")
    totals = {r[0]: r[1] for r in words.groupBy("class").agg(F.sum("n")).collect()}  # one row for each language
    lengths = {(r[0], r[1]): r[2] for r in grams.groupBy("class", F.length("gram")).agg(F.sum("n")).collect()}  # four for each
    languages = sorted(totals)
    if not languages:
        none = docs.sparkSession.createDataFrame([], "unit string, s array<long>, n long")
        return LanguageModel([], none, none, 0)
    of = lambda numbers: F.array(*(F.lit(float(1 + x)) for x in numbers))
    by_length = F.element_at(F.array(*(of(lengths.get((x, k), 0) for x in languages) for k in range(1, LONGEST + 1))), F.length("unit"))
    word_table = _by_language(words, "unit", of(totals[x] for x in languages), languages)
    word_table = staged(word_table.withColumn("s", _whole(F.col("s"))), f"{path}/word_scores")
    gram_table = _by_language(grams, "gram", by_length, languages)
    gram_table = staged(gram_table.withColumn("s", _whole(F.col("s"))), f"{path}/gram_scores")
    for name in ("words", "grams"):
        removed(docs.sparkSession, f"{path}/{name}")
    return LanguageModel(languages, word_table, gram_table, sum(totals.values()))


def backoff(words: DataFrame, model: LanguageModel, path: str) -> DataFrame:
    """unit, s for distinct words (unit): the mean of the longest n-grams that are known; zeros if none is.

    Lengths go one by one: only words without a known n-gram are looked up by shorter ones.
    """
    width, left, found = len(model.languages), words, []
    ends = F.concat(F.lit("_"), "unit", F.lit("_"))
    grams = model.grams.select(F.col("unit").alias("gram"), "s")
    for k in range(LONGEST, 0, -1):
        if left.isEmpty():
            break
        each = F.transform(F.sequence(F.lit(1), F.length(ends) - (k - 1)), lambda i: F.substr(ends, i, F.lit(k)))  # noqa: B023
        places = left.where(F.length(ends) >= k).select("unit", F.explode(each).alias("gram"))
        sizes = places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        known = salted_join(places, grams.where(F.length("gram") == k), "gram", sizes, left.count(), "unit")
        sums = known.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)))
        means = F.when(F.col("n").isNotNull(), F.array(*(F.round(F.col(f"s{i}") / F.col("n")).cast("long") for i in range(width))))
        step = staged(left.join(sums, "unit", "left").select("unit", means.alias("s")), f"{path}/backoff{k}")
        found.append(step.where("s is not null"))
        left = step.where("s is null").select("unit")
    out = left.select("unit", F.array(*(F.lit(0).cast("long") for _ in range(width))).alias("s"))
    for step in found:
        out = out.unionByName(step)
    return out


def identified(docs: DataFrame, model: LanguageModel, columns: tuple[str, ...] = ("doc_id",), share: float = SHARE, path: str | None = None) -> DataFrame:
    """The named columns of each row and lang_pred, score; only the text is looked at."""
    spark, width = docs.sparkSession, len(model.languages)
    text = free_name([*columns, "lang_pred", "score"], "text")
    kept = docs.select(*(F.col(f"`{c}`") for c in columns), F.col("text").alias(text))
    if not width:
        return kept.drop(text).withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    small_batches(spark)
    path = path or workspace(spark)
    names = [f"c{i}" for i in range(len(columns))]
    common = model.words.where(F.col("n") >= share * model.total).select("unit", "s").toArrow()  # at most 1 / share rows
    scores = np.asarray(common.column(1).combine_chunks().flatten()).reshape(-1, width)
    shared = spark.sparkContext.broadcast((dict(zip(common.column(0).to_pylist(), range(len(scores)), strict=True)), scores))
    schema = "".join(f"{n} {f.dataType.simpleString()}, " for n, f in zip(names, kept.schema, strict=False)) + "rid long, n_words long, own array<long>, rare array<string>, times array<long>"
    fields = schema_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, table = shared.value
        for batch in batches:
            for part in steps(batch, len(columns)):
                made: list[list] = [[], [], [], []]
                for x in part.column(len(columns)).to_pylist():
                    words = words_of(x) if x else []
                    counted = Counter(words)
                    at, times, rare, rare_times = [], [], [], []
                    for word, n in counted.items():
                        i = place.get(word)
                        if i is None:
                            rare.append(word)
                            rare_times.append(n)
                        else:
                            at.append(i)
                            times.append(n)
                    own = np.asarray(times, np.int64) @ table[at] if at else np.zeros(width, np.int64)
                    letters = bool(x) and any(map(str.isalpha, x))
                    for column, value in zip(made, (len(words) if letters else None, own, rare, rare_times), strict=True):
                        column.append(value)
                arrays = [*part.columns[: len(columns)], part.column(len(columns) + 1)]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, f.type) for c, f in zip(made, [*fields][-4:], strict=True))], schema=fields)

    plain = kept.toDF(*names, text).withColumn("rid", F.monotonically_increasing_id())
    rows = staged(plain.mapInArrow(run, schema), f"{path}/rows")
    rare = rows.select("rid", F.explode(F.arrays_zip(F.col("rare").alias("unit"), "times")).alias("w")).select("rid", "w.unit", "w.times")
    units = staged(rare.groupBy("unit").agg(F.count(F.lit(1)).alias("n")), f"{path}/units")
    looked_up = staged(units.join(model.words.select("unit", "s"), "unit", "left"), f"{path}/looked_up")
    known, unseen = looked_up.where("s is not null").select("unit", "s"), staged(looked_up.where("s is null").select("unit"), f"{path}/unseen")
    found = staged(known.unionByName(backoff(unseen, model, path)), f"{path}/scores")
    for name in ("looked_up", "unseen", *(f"backoff{k}" for k in range(1, LONGEST + 1))):
        removed(spark, f"{path}/{name}")
    total = units.agg(F.sum("n")).first()[0] or 0
    met = salted_join(rare, found, "unit", units, total, "rid")
    sums = met.groupBy("rid").agg(*(F.sum(F.col("times") * F.col("s")[i]).alias(f"s{i}") for i in range(width)))

    whole = rows.drop("rare", "times").join(sums, "rid", "left")
    each = [(F.col("own")[i] + F.coalesce(f"s{i}", F.lit(0))) / F.lit(float(SCALE)) / F.sqrt(F.greatest("n_words", F.lit(1))) for i in range(width)]
    whole = whole.withColumn("each", F.array(*each)).withColumn("most", F.array_max("each"))
    language = F.element_at(F.array(*map(F.lit, model.languages)), F.array_position("each", F.col("most")).cast("int"))
    certain = 1 / F.aggregate("each", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    of_text = F.col("n_words").isNotNull()
    return whole.select(*(F.col(n).alias(c) for n, c in zip(names, columns, strict=True)), F.when(of_text, language).otherwise("und").alias("lang_pred"), F.when(of_text, certain).otherwise(0.0).alias("score"))


def held_out(docs: DataFrame) -> DataFrame:
    """With a column held_out: crc32 of the doc_id as text has the remainder 2 by 4 (null doc_id: false)."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that aren't ``und``; ``lang`` is the language found.

    The model is learned from the rows' own labels, without the held-out ones. If there are none to learn from, rows whose
    text has a letter stay as they are.
    """
    names, key = docs.columns, free_name(docs.columns)
    model = learn(held_out(docs.select("doc_id", "text", "lang")).where("not held_out and doc_id is not null"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    path = workspace(docs.sparkSession)
    found = identified(docs.select(row_key().alias(key), "text"), model, (key,), path=path).groupBy(key).agg(F.first("lang_pred").alias("found"))
    found = staged(found.where("found <> 'und'").select(key, F.col("found").alias(f"{key}_found")), f"{path}/found")
    both = docs.withColumn(key, row_key()).join(found, key)
    return both.select(*(F.col(f"{key}_found").cast(docs.schema["lang"].dataType).alias("lang") if n == "lang" else F.col(f"`{n}`") for n in names))
