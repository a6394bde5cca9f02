"""A cleaned and packed corpus: language, exact copies, near copies, personal data, sequences.

Each stage takes (spark, docs, sf_dir); all but the last return rows with the columns of ``documents``. For all of them:
an empty table gives an empty table with the same columns; nulls may stand in any column; other columns stay as they are,
whatever their names; no length of text is too long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import exact_dedup, langid, near_dedup, packing, pii
from lathe.llm.common import staged, workspace
from lathe.llm.queries import TOKENIZER


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their language found, in ``lang``; those without any letter go, so null and empty texts do.

    A tie between languages goes to the first by name. Repeated rows all stay. Without labels to learn from, ``lang`` stays.
    """
    return langid.accepted(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id.

    Null texts count as empty, and empty ones are equal. A null doc_id comes last; of rows repeated with one doc_id, one stays.
    """
    return exact_dedup.deduplicated(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest doc_id.

    Texts without words, null ones too, are alone in their class. A null doc_id comes last; of repeated rows, one stays.
    """
    return near_dedup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by names of its kinds.

    Null and empty texts stay as they are; so does n_chars of texts without personal data. Repeated rows all stay.
    """
    return pii.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids.

    A null or empty text holds its end id alone. Repeated rows are all packed. Rows keep the order of their files.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("sequences", sequences),
]

#: Languages, near copies and token ids are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = workspace(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
