"""Operator 6: url filters by rules, and by the ratio of two character language models where no rule fits.

The models are smoothed Markov models of variable order: the probability of a character behind the five before it mixes
all shorter contexts (Witten-Bell: a context that was seen often and with few followers counts more). One is learned from
urls that rules allow, one from those that rules block. All strings of all such urls count, however rare: the models are
tables that grow with the input. A url's score is the difference of its log likelihoods, divided by its length.

Each place of a url gives one string of six characters. The distinct ones of all urls get their counts by class; counts of
shorter strings and of contexts are sums of these, and the probabilities of each length are joined with those of the next
shorter one. Then the urls' strings are joined with their scores; frequent strings are dealt to several tasks.

The threshold is calibrated on a quarter of the ruled urls (by a hash of page_id) with models of the others: the middle of
the best range by the mean of both classes' accuracy. If rules allow no url or block none, all urls without a rule are
allowed and scores are 0.

Null urls and those without ``://`` have an empty host and path, so no rule; a null url scores 0 and is allowed if the
threshold is not above 0. A very long url is a row for each of its characters on the way. Repeated rows give repeated rows;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import removed, salted_join, staged, workspace

#: Host and path start, verdict.
RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
ORDER = 6
BINS = 4000
#: The probability that the shortest context is mixed with, for each character.
FLOOR = 1 / 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Models: those of all ruled urls, and those without the quarter for calibration, each by the folds that it counts.
_MODELS = {"whole": ("0", "1"), "part": ("0",)}


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule (of those that fit the longest; null: none), ruled (its verdict)."""
    host, path = host_and_path(F.col("url"))
    out = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = ruled = None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, slash, start = text.partition("/")
        fits = ((F.col("host") == own) | F.endswith("host", F.lit(f".{own}"))) & F.startswith("path", F.lit(slash + start))
        rule = _or_else(rule, fits, text)
        ruled = _or_else(ruled, fits, verdict)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "ruled": none if ruled is None else ruled})


def _or_else(before: Column | None, fits: Column, value: str) -> Column:
    return F.when(fits, value) if before is None else before.when(fits, value)


def plain(url: Column) -> Column:
    """What the models see: no scheme, no letter case, all digits alike."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(url)
    return F.lower(F.translate(rest, "123456789", "000000000"))


def strings_of(url: Column) -> Column:
    """For each character of the plain url, and for its end, that character and the five before it."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), plain(url), F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - (ORDER - 1)), lambda i: F.substr(padded, i, F.lit(ORDER)))


def _counted(places: DataFrame) -> DataFrame:
    """gram, n (places), and by class and fold allow0, allow1, block0, block1."""
    by = {f"{c}{f}": F.count_if((F.col("ruled") == c) & (F.col("fold") == f)) for c in ("allow", "block") for f in (0, 1)}
    return places.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), *(a.alias(k) for k, a in by.items()))


def gram_scores(counted: DataFrame) -> DataFrame:
    """gram, whole, part: the difference of the log probabilities of its last character behind the others."""
    names = [f"{c}{f}" for c in ("allow", "block") for f in (0, 1)]
    models = [(c, m) for c in ("allow", "block") for m in _MODELS]

    def of(c: str, m: str) -> Column:
        return sum((F.coalesce(f"{c}{f}", F.lit(0)) for f in _MODELS[m]), F.lit(0))

    lower = None
    for n in range(1, ORDER + 1):
        grams = counted.groupBy(F.right("gram", F.lit(n)).alias("g")).agg(*(F.sum(x).alias(x) for x in names)).select("g", *(of(c, m).alias(f"{c}_{m}") for c, m in models))
        grams = grams.withColumn("context", F.left("g", F.lit(n - 1)))
        contexts = grams.groupBy("context").agg(*(a.alias(f"{k}_{c}_{m}") for c, m in models for k, a in (("sum", F.sum(f"{c}_{m}")), ("kinds", F.count_if(F.col(f"{c}_{m}") > 0)))))
        both = grams.join(contexts, "context")
        if lower is not None:
            both = both.withColumn("tail", F.right("g", F.lit(n - 1))).join(lower, "tail")
        mixed = []
        for c, m in models:
            before = F.lit(FLOOR) if lower is None else F.col(f"p_{c}_{m}")
            total, kinds = F.col(f"sum_{c}_{m}"), F.col(f"kinds_{c}_{m}")
            mixed.append(F.when(total > 0, (F.col(f"{c}_{m}") + kinds * before) / (total + kinds)).otherwise(before).alias(f"p_{c}_{m}"))
        lower = both.select(F.col("g").alias("tail"), *mixed)
    return lower.select(F.col("tail").alias("gram"), *((F.log(f"p_allow_{m}") - F.log(f"p_block_{m}")).alias(m) for m in _MODELS))


def _threshold(histogram: list) -> float:
    """The middle of the best range of bins, from rows (ruled, bin, n)."""
    n = {"allow": np.zeros(BINS + 1), "block": np.zeros(BINS + 1)}
    for ruled, at, many in histogram:
        n[ruled][at] += many
    if not n["allow"].sum() or not n["block"].sum():
        return 0.0
    right = n["allow"][::-1].cumsum()[::-1] / n["allow"].sum() + np.concatenate([[0], n["block"].cumsum()[:-1]]) / n["block"].sum()
    best = np.flatnonzero(right == right.max())
    return float((best[0] + best[-1]) / 2 / BINS * 20 - 10)


def judged(pages: DataFrame, rules: tuple = RULES, path: str | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score for each row."""
    spark = pages.sparkSession
    path = path or workspace(spark)
    fold = F.coalesce((F.crc32(F.col("page_id").cast("string")) % 4 == 0).cast("int"), F.lit(0))
    rows = with_rules(pages, rules).withColumns({"fold": fold, "rid": F.monotonically_increasing_id()})
    rows = staged(rows, f"{path}/rows")
    places = rows.select("rid", "ruled", "fold", F.explode(strings_of(F.col("url"))).alias("gram"))
    counted = staged(_counted(places), f"{path}/counted")
    scores = staged(gram_scores(counted), f"{path}/scores")
    total = counted.agg(F.sum("n"), F.sum(F.col("allow0") + F.col("allow1")), F.sum(F.col("block0") + F.col("block1"))).first()
    able = bool(total[1] and total[2])

    met = salted_join(places.select("rid", "gram"), scores, "gram", counted.select("gram", "n"), total[0] or 0, "rid")
    sums = met.groupBy("rid").agg((F.sum("whole") / F.count(F.lit(1))).alias("whole"), (F.sum("part") / F.count(F.lit(1))).alias("part"))
    zero = F.lit(0.0)
    found = rows.drop("url").join(sums, "rid", "left").withColumns({m: F.coalesce(m, zero) if able else zero for m in _MODELS})
    found = staged(found, f"{path}/found")
    for name in ("rows", "counted", "scores"):
        removed(spark, f"{path}/{name}")
    bins = F.least(F.greatest(F.round((F.col("part") + 10) / 20 * BINS), F.lit(0)), F.lit(BINS)).cast("int")
    histogram = found.where("ruled is not null and fold = 1").groupBy("ruled", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * (BINS + 1) rows
    passes = F.lit(True) if not able else F.col("whole") >= _threshold(histogram)
    verdict = F.coalesce("ruled", F.when(passes, "allow").otherwise("block"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("whole").alias("score"))
