"""Operator 5: licence scans by diagonal voting, in DataFrame operations only.

All rolling hashes of a text's word k-grams are joined to the positions of k-grams in templates (a fixed list, so it is
broadcast; k-grams found by their hash are compared word by word). Sentences and base phrases go by pairs of words, whole
licence texts (``license_texts.txt``) by four words, as pairs of them are common in prose. A match of text position p and
template position t votes for the diagonal p - t. Votes are summed by diagonal. Diagonals of one template up to ``GAP``
apart (words were put in or left out) are merged around each diagonal; the merged span is verified by the distinct
template positions that it covers, and counts if they are ``coverage`` (0.82) of all. So a span is never longer than its
template and twice ``GAP``, and templates may be of any length. A base phrase counts wherever all its words stand consecutively.

Null and empty texts have no words, labels or places and score 0. A very long text has a row for each of its words on the
way, and its matches meet in one task. Repeated rows give repeated rows; an empty table gives an empty table; other columns
of the input are ignored.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lathe.llm.common import text_or_empty

#: Phrase and label.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Template and label: well-known sentences of public licences, as words.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
#: Diagonals this near are one span.
GAP = 4
#: Templates of more words than this go by k-grams of four words.
SENTENCE = 25

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def plain_words(text: str) -> list[str]:
    """As ``words_of``, of a Python string of ASCII characters."""
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


def whole_texts(path: str = str(Path(__file__).with_name("license_texts.txt"))) -> tuple[tuple[str, str], ...]:
    """Template and label from a file: ``== label`` in a line, then the text."""
    parts = Path(path).read_text().split("== ")[1:]
    return tuple((" ".join(plain_words(body)), label) for label, _, body in (p.partition("\n") for p in parts))


def template_grams(phrases: tuple, templates: tuple) -> list[tuple]:
    """(template, t, k, gram, label, grams, base): each k-gram of each template at its position t."""
    out = []
    for number, (text, label, base) in enumerate([*((p, x, True) for p, x in phrases), *((p, x, False) for p, x in templates)]):
        words = text.split()
        k = 2 if len(words) <= SENTENCE else 4
        out += [(number, t, k, " ".join(words[t : t + k]), label, len(words) - k + 1, base) for t in range(len(words) - k + 1)]
    return out


def _grams(spark: SparkSession, phrases: tuple, templates: tuple) -> DataFrame:
    schema = T.StructType.fromDDL("template int, t int, k int, gram0 string, label string, grams int, base boolean")
    return spark.createDataFrame(template_grams(phrases, templates), schema).withColumn("h", F.xxhash64("gram0"))


def license_spans(docs: DataFrame, phrases: tuple = BASE_PHRASES, templates: tuple | None = None) -> DataFrame:
    """Merged spans: rid, doc_id, n_words, template, label, base, covered (0 to 1), first, last, places, first_place, last_place.

    ``first`` and ``last`` are word positions; places are starts of a whole base phrase, word for word. There is a span for
    each diagonal. A text without any match has one row with a null template. ``rid`` tells rows of ``docs`` apart.
    """
    found = _grams(docs.sparkSession, phrases, TEMPLATES + whole_texts() if templates is None else templates)
    texts = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(text_or_empty()).alias("words"))
    texts = texts.withColumn("n_words", F.size("words").cast("long"))
    n = F.col("n_words").cast("int")
    zipped = F.arrays_zip(F.col("words").alias("a"), *(F.slice("words", i + 2, F.greatest(n - i, F.lit(1))).alias(x) for i, x in enumerate("bcd")))
    rows = texts.select("rid", "doc_id", "n_words", F.posexplode_outer(zipped).alias("p", "w"))
    two = F.concat_ws(" ", "w.a", "w.b")
    both = F.when(F.col("w.d").isNotNull(), F.array(two, F.concat_ws(" ", two, "w.c", "w.d"))).otherwise(F.array(two))
    grams = rows.select("rid", "doc_id", "n_words", "p", F.explode(both).alias("gram"))
    votes = grams.join(F.broadcast(found), (F.xxhash64("gram") == F.col("h")) & (F.col("gram") == F.col("gram0")), "left")
    votes = votes.where("template is not null or p is null or p = 0")
    # Few rows are left: matches, and one or two rows a text. All rows of a text meet once, for all that follows.
    votes = votes.select("rid", "doc_id", "n_words", "template", "label", "k", "grams", "base", (F.col("p") - F.col("t")).cast("long").alias("diagonal"), "t").repartition("rid")
    text = ["rid", "doc_id", "n_words", "template", "label", "grams", "base"]
    at = F.col("diagonal") + F.col("t")
    lines = votes.groupBy(*text, "diagonal").agg(F.collect_set("t").alias("own"), F.min(at).alias("first"), F.max(at + F.col("k")).alias("last"))
    near = Window.partitionBy("rid", "template").orderBy("diagonal").rangeBetween(-GAP, GAP)
    whole = F.col("base") & (F.size("own") == F.col("grams"))
    place = F.when(whole, F.col("diagonal"))
    return lines.select(
        "rid", "doc_id", "n_words", "template", "label", "base",
        F.when(F.col("base"), F.size("own")).otherwise(F.size(F.array_distinct(F.flatten(F.collect_list("own").over(near))))).cast("double").alias("matched"), "grams",
        F.min("first").over(near).alias("first"), F.max("last").over(near).alias("last"),
        F.coalesce(whole, F.lit(False)).cast("long").alias("places"), place.alias("first_place"), place.alias("last_place"),
    ).withColumn("covered", F.col("matched") / F.col("grams")).drop("matched", "grams")


def license_report(docs: DataFrame, phrases: tuple = BASE_PHRASES, templates: tuple | None = None, coverage: float = 0.82) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    ``labels`` holds those of base phrases and of spans that cover enough of a template; ``score`` is the best cover.
    """
    spans = license_spans(docs, phrases, templates)
    base = F.col("base") & (F.col("places") > 0)
    good = base | (~F.col("base") & (F.col("covered") >= coverage))

    def joined(when: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(when, F.col("label")))), ",")

    return spans.groupBy("rid", "doc_id", "n_words").agg(
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0).cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first_place"))).alias("first_word"), F.max(F.when(base, F.col("last_place"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(good).alias("labels"),
        F.coalesce(F.max(F.when(base, F.lit(1.0)).when(~F.col("base"), F.col("covered"))), F.lit(0.0)).alias("score"),
    ).drop("rid")
