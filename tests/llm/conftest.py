import random

import pytest

#: Columns of documents, and others whose names the operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, digest string, words string, n long, rid long, h long, comp long, part int, spans string, score double, kept boolean, `a.b` string"


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), "x", "x", "x", 1, 1, 1, 1, 1, "x", 0.5, True, "x")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["the", "and", "on", "er", "ing", "sto"]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, near copies."""
    base = prose(1, 200)
    near = base.split()
    near[50] = "changed"
    rows = [
        row(1, None), row(2, ""), row(3, ""), row(None, base), row(5, base), row(5, base), row(6, base), row(7, " ".join(near)), row(8, "12 ³ !!"),
        row(9, prose(2, 30000)), row(10, "x" * 200_000), row(11, " \n\t "), row(12, "a  b c ͸ don't 'S", None, None), row(13, prose(3, 40)),
        row(13, prose(4, 40)), row(14, "ж" * 3000 + " и " * 5), row(15, "one two"), row(16, prose(1, 200) + "\n" + prose(1, 200)), row(None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
