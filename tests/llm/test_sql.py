from collections import Counter

import duckdb
import pytest
from pyarrow import parquet

from lathe.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="session")
def odd_dir(odd, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    parquet.write_table(odd.toArrow(), path / "documents.parquet")
    return str(path)


@pytest.mark.parametrize("rows", ["sf_dir", "odd_dir"])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, request, name, rows):
    folder = request.getfixturevalue(rows)
    with duckdb.connect() as tables:
        tables.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        want = tables.execute(ORACLE_SQL[name])
        columns = [c[0] for c in want.description]
        want = Counter(want.fetchall())
    df = QUERIES[name](spark, folder)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == want
