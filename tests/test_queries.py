"""All queries of the algebra against DuckDB."""

import duckdb
import pytest

from lathe.plans.catalog import TEST_TABLES
from lathe.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TEST_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, oracle, name):
    found = QUERIES[name](spark, sf_dir)
    want = oracle.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(found.columns) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_histogram(spark, sf_dir):
    rows = QUERIES["stats_histogram"](spark, sf_dir).orderBy("lower_bound").collect()
    total = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert len(rows) == 10 and sum(r.frequency for r in rows) == total
    assert all(0.08 * total <= r.frequency <= 0.12 * total for r in rows)
    assert all(a.upper_bound < b.lower_bound for a, b in zip(rows, rows[1:], strict=False))


def test_approx_distinct(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for r in QUERIES["stats_approx_distinct"](spark, sf_dir).collect():
        assert r.distinct_values == table.select(r.column_name).distinct().count() and r.sketch_is_close


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    pruned = plan(QUERIES["scan_pruned"](spark, sf_dir))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in pruned
    assert "GreaterThanOrEqual(p_size,40)" in plan(QUERIES["scan_pushed_filter"](spark, sf_dir))
    assert "SortMergeJoin" in plan(QUERIES["join_sort_merge"](spark, sf_dir))
    assert "ShuffledHashJoin" in plan(QUERIES["join_hash_shuffle"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan(QUERIES["join_hash"](spark, sf_dir))
    assert "might_contain" in plan(QUERIES["join_dynamic_filter"](spark, sf_dir))
    assert "CartesianProduct" in plan(QUERIES["cross_join_partitioned"](spark, sf_dir))
    assert "SortMergeJoin" in plan(QUERIES["join_auto"](spark, sf_dir))
    for name in QUERIES:
        if name.startswith("sort_") or name == "flagship":
            assert "SinglePartition" not in plan(QUERIES[name](spark, sf_dir))
    for name in ("flagship", "join_multiway_6", "join_out_of_order", "join_inner_equi"):
        assert "Cartesian" not in plan(QUERIES[name](spark, sf_dir)) and "NestedLoop" not in plan(QUERIES[name](spark, sf_dir))
