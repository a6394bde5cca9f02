"""One query for each operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import bpe, exact_dedup, idfiles, langid, licenses, near_dedup, packing, pii, quality, urls
from lathe.llm.common import workspace

#: Vocabulary files; a cluster with another place for them gives the operators another path.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir), RANKS, PATTERN)


def op2_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = idfiles.through_files(_documents(spark, sf_dir), workspace(spark), TOKENIZER, end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir), keep="largest")


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir)).drop("sha")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_documents(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = langid.held_out(_documents(spark, sf_dir))
    model = langid.learn(docs.where("not held_out and doc_id is not null"))
    return langid.identified(docs, model, ("doc_id", "held_out"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.cleaned(_documents(spark, sf_dir)).drop("cleaned_text")


def op10_concat_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), TOKENIZER).drop("ids")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_huffman_ids, op3_exact_dedup, op4_dart_minhash, op5_license_scan, op6_url_filter, op7_personal_data, op8_language_id, op9_line_quality, op10_concat_and_cut, pipeline)
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _license_sql() -> str:
    """Votes of shared word pairs (fours, for whole texts) by diagonal; positions on diagonals up to ``GAP`` apart count together."""
    every = [(text, label, True) for text, label in licenses.BASE_PHRASES] + [(text, label, False) for text, label in licenses.TEMPLATES + licenses.whole_texts()]
    rows = ", ".join(f"({i}, {_quoted(text)}, {_quoted(label)}, {base})" for i, (text, label, base) in enumerate(every))
    return rf"""
        WITH templates AS (
            SELECT template, label, base, string_split(body, ' ') AS words FROM (VALUES {rows}) AS v(template, body, label, base)
        ), sized AS (
            SELECT *, CASE WHEN len(words) <= {licenses.SENTENCE} THEN 2 ELSE 4 END AS k FROM templates
        ), places AS (
            SELECT *, len(words) - k + 1 AS grams, unnest(range(0, len(words) - k + 1)) AS t FROM sized
        ), parts AS (
            SELECT template, label, base, k, grams, t, array_to_string(words[t + 1 : t + k], ' ') AS gram FROM places
        ), texts AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), starts AS (
            SELECT r, words, unnest(range(0, len(words) - 1)) AS p FROM texts
        ), shingles AS (
            SELECT r, p, 2 AS k, array_to_string(words[p + 1 : p + 2], ' ') AS gram FROM starts
            UNION ALL
            SELECT r, p, 4 AS k, array_to_string(words[p + 1 : p + 4], ' ') AS gram FROM starts WHERE p + 4 <= len(words)
        ), votes AS (
            SELECT DISTINCT r, template, label, base, grams, p - t AS diagonal, t FROM shingles JOIN parts USING (k, gram)
        ), phrases AS (
            SELECT r, label, diagonal FROM votes WHERE base GROUP BY r, template, label, grams, diagonal HAVING count(*) = grams
        ), diagonals AS (
            SELECT DISTINCT r, template, label, grams, diagonal FROM votes WHERE NOT base
        ), covers AS (
            SELECT d.r, d.label, count(DISTINCT v.t) / d.grams AS covered
            FROM diagonals AS d JOIN votes AS v
              ON v.r = d.r AND v.template = d.template AND v.diagonal BETWEEN d.diagonal - {licenses.GAP} AND d.diagonal + {licenses.GAP}
            GROUP BY d.r, d.template, d.label, d.grams, d.diagonal
        ), based AS (
            SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
                   array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels
            FROM phrases GROUP BY r
        ), labelled AS (
            SELECT r, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
            FROM (SELECT r, label FROM phrases UNION ALL SELECT r, label FROM covers WHERE covered >= 0.82) GROUP BY r
        ), scored AS (
            SELECT r, max(score) AS score
            FROM (SELECT r, 1.0::DOUBLE AS score FROM phrases UNION ALL SELECT r, covered::DOUBLE FROM covers) GROUP BY r
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
               last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
               coalesce(score, 0)::DOUBLE AS score
        FROM texts LEFT JOIN based USING (r) LEFT JOIN labelled USING (r) LEFT JOIN scored USING (r)
    """


def _quality_sql() -> str:
    """Lines and windows as rows; equal windows are found by their words."""
    return rf"""
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), lines AS (
            SELECT r, unnest(string_split(t, chr(10))) AS line FROM texts
        ), counted AS (
            SELECT r, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(line, '[|»›·•]')) AS separators,
                   regexp_matches(line, '[.!?…。！？:;]') AS ended, regexp_matches(lower(line), {_quoted("|".join(quality.BOILERPLATE))}) AS framed
            FROM lines
        ), by_line AS (
            SELECT r, (count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0)) AS n_dup_lines,
                   coalesce(sum(n) FILTER ((n >= 8 AND NOT ended) OR (separators >= 3 AND 3 * separators >= n) OR framed), 0) AS lost_words
            FROM counted GROUP BY r
        ), windows AS (
            SELECT r, i, array_to_string(words[i + 1 : i + {quality.WINDOW}], ' ') AS phrase
            FROM (SELECT r, words, unnest(range(0, len(words) - {quality.WINDOW - 1})) AS i FROM texts)
        ), repeated AS (
            SELECT r, unnest(range(i, i + {quality.WINDOW})) AS place
            FROM (SELECT r, i, count(*) OVER (PARTITION BY r, phrase) AS times FROM windows) WHERE times > 1
        ), by_word AS (
            SELECT r, count(DISTINCT place) AS n_repeat_words FROM repeated GROUP BY r
        ), whole AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
                   len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
                   coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, lost_words::BIGINT AS lost_words
            FROM texts JOIN by_line USING (r) LEFT JOIN by_word USING (r)
        )
        SELECT *, NOT base_failed AND 2 * lost_words <= n_words AS kept
        FROM (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM whole)
    """


ORACLE_SQL = {
    "op5_license_scan": _license_sql(),
    "op9_line_quality": _quality_sql(),
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(t) AS text_sha256
        FROM d
    """,
}
