"""Operator 9: line-first cleaning, in DataFrame operations only. Each row is judged by itself, nothing is shuffled.

Lines (between \\n) are judged one by one. A line with words fails if it is long and has no sentence end at all
(punctuation), if it is a list of short links between separators (navigation), or if it has one of a list of phrases of
web pages (boilerplate). Failed lines are removed. A text is kept unless the base rules fail it or it loses more than half
of its words.

A text is one row throughout; a very long one holds a hash for each of its words beside them. A null text has no words; it fails, like all texts of under 20 words. Repeated rows give repeated rows; an empty table
gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import text_or_empty

_SPACES = " \t\n\x0b\f\r"
_WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
_SYMBOLS = "#*$%&|<>"
#: Phrases, in lower case, that mark a line of a web page's frame.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "we use cookies", "privacy policy", "terms of use", "terms of service", "click here to",
    "enable javascript", "skip to content", "sign in to", "subscribe to our newsletter",
    "alle rechte vorbehalten", "wir verwenden cookies", "zum inhalt springen", "newsletter abonnieren", "allgemeine gesch", "hier klicken",
    "tous droits r", "nous utilisons des cookies", "politique de confidentialit", "conditions d'utilisation", "cliquez ici", "aller au contenu",
    "todos los derechos reservados", "utilizamos cookies", "pol\u00edtica de privacidad", "haga clic aqu", "saltar al contenido",
)
_SEPARATORS = r"[|»›·•]"
_ENDS = r"[.!?…。！？:;]"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def windows_of(words: Column, n: int = WINDOW) -> Column:
    """A hash of each n consecutive words."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) >= n, hashes).otherwise(F.array().cast("array<bigint>"))


def with_repeated_words(rows: DataFrame, n: int = WINDOW) -> DataFrame:
    """Adds n_repeat_words to rows with ``windows``: how many words lie in a window that occurs twice or more.

    If all windows differ, none. Else windows are sorted by hash, so that equal ones stand together, and the words they
    cover are summed by the gaps between their starts. Each step is a column of its own, so that it is computed once.
    """
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    at, last = F.col("sorted"), F.size("sorted") - 1
    twice = F.transform(at, lambda x, j: F.when(((j > 0) & (F.get(at, j - 1)["h"] == x["h"])) | ((j < last) & (F.get(at, j + 1)["h"] == x["h"])), x["i"]))
    total = F.aggregate(
        "starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + (i + n - F.greatest(i, a["end"])).cast("long")).alias("n"), (i + n).alias("end")),
    )
    rows = rows.withColumn("sorted", F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr("array(named_struct('h', 0L, 'i', 0))")))
    rows = rows.withColumn("starts", F.sort_array(F.filter(twice, lambda i: i.isNotNull())))
    return rows.withColumn("n_repeat_words", total["n"]).drop("sorted", "starts")


def _failed(line: Column) -> Column:
    words = F.regexp_count(line, F.lit(_WORD))
    separators = F.regexp_count(line, F.lit(_SEPARATORS))
    phrase = F.exists(F.array(F.lower(line)), lambda low: reduce(Column.__or__, map(low.contains, BOILERPLATE)))
    return ((words >= 8) & ~line.rlike(_ENDS)) | ((separators >= 3) & (3 * separators >= words)) | phrase


def cleaned(docs: DataFrame, most_lost: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words, cleaned_text."""
    text = docs.select("doc_id", text_or_empty().alias("text"))
    one = text.select(
        "doc_id", "text", words_of(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.split("text", "\n").alias("every"),
    )
    two = one.withColumn("windows", windows_of(F.col("words")))
    three = with_repeated_words(two).select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.array_join(F.filter("every", lambda x: ~_failed(x)), "\n").alias("cleaned_text"),
    )
    four = three.withColumn("lost_words", F.col("n_words") - F.regexp_count("cleaned_text", F.lit(_WORD)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    five = four.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost_words") <= most_lost * F.col("n_words")))
    return five.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "cleaned_text")
