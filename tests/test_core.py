import datetime
import json
import math

import pytest
from pyspark.sql import types as T

from lathe import Catalog, PlanError, QueryBuilder, compile_query, from_json, to_json
from lathe.cli import main
from lathe.functions.text import float_text
from lathe.harness import QueryCase, run_cases
from lathe.operators import statistics
from lathe.operators.relational import JOIN_HINTS
from lathe.plans.builder import MultiPredicateBuilder, MultiProjectBuilder, MultiSortBuilder, column, f32, f64, i32, i64, string
from lathe.plans.catalog import TEST_TABLES, ColumnSpec, TableSpec
from lathe.plans.ir import IRError, Value
from lathe.sources import blocks, pipe
from lathe.streaming.rows import framed, lines

scan = QueryBuilder.scan
DEMO = (
    scan("A").cross(scan("B")).filter("a1", "EQ", column("b1")).filter("b3", "GTE", i32(0))
    .sort_multiple(MultiSortBuilder("a2", True).add("b2", False)).project_multiple(MultiProjectBuilder("a1", "id").add("b2", "b2")).build()
)


@pytest.fixture(scope="module")
def demo(spark):
    a = spark.createDataFrame([(1, 5), (2, 4), (2, 3), (9, 9)], "a1 int, a2 int")
    b = spark.createDataFrame([(1, 7, 1), (2, 8, 0), (2, 9, 5), (2, 1, -1)], "b1 int, b2 int, b3 int")
    return Catalog({"A": a, "B": b})


def test_json_round_trip():
    text = to_json(DEMO)
    assert from_json(text) == DEMO and json.loads(text)["root"]["Project"]["column_name_map"] == [["a1", "id"], ["b2", "b2"]]
    assert json.loads(text)["root"]["Project"]["underlying"]["Sort"]["underlying"]["Filter"]["predicates"] == [{"column_name": "b3", "operator": "GTE", "value": {"I32": 0}}]


@pytest.mark.parametrize("text", ["", "[]", '{"root":{}}', '{"root":{"Scan":{}}}', '{"root":{"Limit":{}}}', '{"root":{"Filter":{"predicates":[{"column_name":"a","operator":"LIKE","value":{"I32":1}}],"underlying":{"Scan":{"table_id":"A"}}}}}'])
def test_malformed_json(text):
    with pytest.raises(IRError):
        from_json(text)


@pytest.mark.parametrize(("kind", "value"), [("I32", 1 << 31), ("I64", 1 << 63), ("I32", True), ("I32", 1.5), ("String", 1), ("Bool", True)])
def test_bad_values(kind, value):
    with pytest.raises(IRError):
        Value(kind, value)


def test_demo(demo):
    for hint in (None, "auto", *JOIN_HINTS):
        assert [tuple(r) for r in compile_query(DEMO, demo, join_hint=hint).collect()] == [(2, 9), (2, 8), (2, 9), (2, 8), (1, 7)]


def test_plan_errors(demo):
    bad = [scan("C"), scan("A").filter("x", "EQ", i32(1)), scan("A").filter("a1", "EQ", column("x")), scan("A").project("x", "y"), scan("A").sort("x"), scan("A").cross(scan("A")), scan("A").project_multiple(MultiProjectBuilder("a1", "z").add("a2", "z"))]
    for q in bad:
        with pytest.raises(PlanError):
            compile_query(q.build(), demo)
    with pytest.raises(PlanError):
        compile_query(DEMO, demo, join_hint="magic")
    with pytest.raises(PlanError):
        compile_query(DEMO, demo, semantics="other")


@pytest.fixture(scope="module")
def types5(spark):
    rows = [(-(2**31), -(2**63), -1.5, math.nan, ""), (2**31 - 1, 2**63 - 1, 2.0, -0.0, "é "), (-1, 0, 0.0, 0.0, "abc"), (16777217, 16777217, 16777216.0, math.inf, "5")]
    return Catalog({"t": spark.createDataFrame(rows, "i int, l long, f float, d double, s string")})


def count(catalog, name, op, value, semantics="spark"):
    return compile_query(scan("t").filter(name, op, value).build(), catalog, semantics).count()


def test_comparisons(types5):
    assert count(types5, "l", "GT", i32(0)) == 2 and count(types5, "i", "LTE", i64(-1)) == 2
    assert count(types5, "s", "EQ", i32(5)) == 0 and count(types5, "s", "NE", i32(5)) == 4 and count(Catalog({"t": types5.table("t").selectExpr("nullif(s, 'abc') s")}), "s", "NE", i32(5)) == 3 and count(types5, "s", "LT", f64(5.0)) == 0
    assert count(types5, "i", "EQ", string("-1")) == 0 and count(types5, "i", "NE", string("-1")) == 4
    assert count(types5, "s", "GTE", string("abc")) == 2 and count(types5, "s", "EQ", string("é ")) == 1
    assert count(types5, "d", "EQ", f64(0.0)) == 2 and count(types5, "i", "LT", f32(0.5)) == 2


def test_semantics_modes(types5):
    assert count(types5, "i", "EQ", column("f")) == 0 and count(types5, "i", "EQ", column("f"), "reference") == 1
    assert count(types5, "d", "GT", f64(1.0)) == 2 and count(types5, "d", "GT", f64(1.0), "reference") == 1
    assert count(types5, "d", "EQ", column("d")) == 4 and count(types5, "d", "EQ", column("d"), "reference") == 3
    assert count(types5, "d", "NE", column("d"), "reference") == 1


def test_rewrites_change_nothing(spark, sf_dir):
    catalog = Catalog.of_parquet(spark, sf_dir)
    tests = [("c_custkey", "EQ", column("o_custkey")), ("o_totalprice", "GT", f64(1000.0)), ("c_nationkey", "LT", i32(9))]
    both = [scan("customer").cross(scan("orders")), scan("orders").cross(scan("customer"))]
    found = set()
    for base in both:
        for order in (tests, tests[::-1]):
            stacked, merged = base, MultiPredicateBuilder(*order[0])
            for t in order:
                stacked = stacked.filter(*t)
            for t in order[1:]:
                merged.add(*t)
            for q in (stacked, base.filter_multiple(merged)):
                rows = compile_query(q.project_multiple(MultiProjectBuilder("c_custkey", "c").add("o_orderkey", "o")).build(), catalog).collect()
                found.add(tuple(sorted(map(tuple, rows))))
    assert len(found) == 1 and next(iter(found))


def test_dotted_names(demo):
    q = scan("A").project_multiple(MultiProjectBuilder("a1", "x.a").add("a2", "y`b")).filter("x.a", "EQ", i32(2)).sort("y`b").project("x.a", "x.a")
    assert [r[0] for r in compile_query(q.build(), demo).collect()] == [2, 2]


def test_empty_tables(spark):
    e = Catalog({"A": spark.createDataFrame([], "a1 int, a2 int"), "B": spark.createDataFrame([], "b1 int, b2 int, b3 int")})
    assert compile_query(DEMO, e).collect() == []


@pytest.mark.parametrize(("x", "text"), [(50.0, "50.0"), (19.4, "19.4"), (0.1 + 0.2, "0.3"), (1e15, "1e+15"), (1e20, "1e+20"), (1e-7, "1e-07"), (-0.0, "-0.0"), (math.inf, "inf"), (math.nan, "nan"), (123456789012345.0, "123456789012345.0")])
def test_float_text(x, text):
    assert float_text(x) == text


def test_result_stream(spark):
    df = spark.createDataFrame([(1, 19.4, "alpha"), (2, 50.0, "")], "id int, amount double, name string").coalesce(1)
    assert list(lines(df)) == ["1|19.4|alpha|", "2|50.0||"]
    assert list(framed(df)) == ["validate", "1|19.4|alpha|", "2|50.0||", "!"]


def test_schema_files():
    spec = pipe.parse_schema("id|amount|name|\ni32|FLOAT64|String|I64|\n", "t")
    assert [(c.name, c.kind) for c in spec.columns] == [("id", "Int32"), ("amount", "Float64"), ("name", "String")]
    assert pipe.parse_schema(pipe.schema_text(spec.schema()), "t") == spec
    for bad in ("a|b\nI32", "a\nDATE", "a"):
        with pytest.raises(pipe.SchemaError):
            pipe.parse_schema(bad, "t")


def test_pipe_files(spark, tmp_path):
    (tmp_path / "t.schema").write_text("a|s|\nI32|STRING|\n")
    (tmp_path / "t.csv").write_text("1|x \n2|\n3||\n4|\"q\"|\n")
    (tmp_path / "u.csv").write_text("1\n")
    found = pipe.discover(spark, str(tmp_path))
    assert list(found.tables) == ["t"]
    assert sorted(map(tuple, found.table("t").collect())) == [(1, "x "), (2, ""), (3, ""), (4, '"q"')]
    for bad in ("1|a|b\n", "1\n", "x|a\n", "\n"):
        (tmp_path / "t.csv").write_text(bad)
        with pytest.raises(Exception, match=r"without 2 values|CAST_INVALID_INPUT"):
            pipe.discover(spark, str(tmp_path)).table("t").collect()


def test_block_files(spark, tmp_path):
    spec = TableSpec("t", "t", [ColumnSpec(n, k) for n, k in zip("ilfds", ("Int32", "Int64", "Float32", "Float64", "String"), strict=True)])
    rows = [(i, i << 33, i / 2, -i / 3, "é" * (i % 50)) for i in range(500)]
    df = spark.createDataFrame(rows, spec.schema()).coalesce(1)
    for size in (256, 4096):
        path = tmp_path / f"b{size}"
        blocks.write_blocks(df, str(path), size)
        assert all(p.stat().st_size % size == 0 for p in path.iterdir())
        assert sorted(map(tuple, blocks.read_blocks(spark, str(path), spec, size).collect())) == rows
    with pytest.raises(ValueError, match="a row of"):
        list(blocks.encode_rows(iter([(1, 1, 1.0, 1.0, "x" * 300)]), spec.schema(), 256))
    with pytest.raises(ValueError, match="zero byte"):
        list(blocks.encode_rows(iter([(1, 1, 1.0, 1.0, "\0")]), spec.schema(), 256))


def test_numbers_alone_in_blocks(spark, tmp_path):
    spec = TableSpec("t", "t", [ColumnSpec(n, k) for n, k in zip("ild", ("Int32", "Int64", "Float64"), strict=True)])
    rows = [(i, -i, i / 7) for i in range(1000)]
    blocks.write_blocks(spark.createDataFrame(rows, spec.schema()).repartition(3), str(tmp_path / "b"), 512)
    assert sorted(map(tuple, blocks.read_blocks(spark, str(tmp_path / "b"), spec, 512).collect())) == rows


def test_statistics_of_all_tables(spark, sf_dir):
    """Arrays, times, 64-bit numbers: no column stops the analysis, and bounds keep their types."""
    for name in TEST_TABLES:
        spec = statistics.analyze(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)
        assert len(json.dumps([c.stats for c in spec.columns])) > 2
    big = spark.createDataFrame([(2**53 + 1, None), (2**53 + 3, None)], "a long, b double")
    assert statistics.bounds(big, ["a", "b"]) == {"a": (2**53 + 1, 2**53 + 3), "b": (None, None)}
    assert [tuple(r) for r in statistics.ranges(big, ["a"]).collect()] == [("a", str(2**53 + 1), str(2**53 + 3))]


def test_string_histogram(spark):
    values = [f"{'aäz'[i % 3]}{i % 40:03d}" for i in range(1200)] + [""] * 300
    rows = statistics.histogram(spark.createDataFrame([(v,) for v in values], "s string"), "s").orderBy("bucket").collect()
    assert sum(r.frequency for r in rows) == 1500 and len(rows) <= 10
    assert all(a.upper_bound.encode() < b.lower_bound.encode() for a, b in zip(rows, rows[1:], strict=False))


def test_histogram_is_exact_beyond_its_sketch(spark):
    """Buckets end at ranks ceil(i * n / 10), whatever the sketch guesses: ties, NaN, nulls, numbers beyond 2**53."""
    n = 150_001
    even = statistics.histogram(spark.range(n).selectExpr(f"(id * 7919) % {n} AS v"), "v").orderBy("bucket").collect()
    ends = [-(-i * n // 10) for i in range(11)]
    assert [tuple(r) for r in even] == [(i, a, b - 1, b - a) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    odd = {
        "long": [2**60 + (i * 61) % 2003 for i in range(5000)] + [None] * 30,
        "double": [float((i * 37) % 1000) ** 2 for i in range(3000)] + [math.nan] * 700 + [7.0] * 900 + [-math.inf] + [None] * 5,
        "date": [datetime.date(2000, 1, 1) + datetime.timedelta(days=(i * 37) % 3001) for i in range(4000)],
    }
    for kind, values in odd.items():
        key = lambda x: (x != x, 0 if x != x else x)
        kept = sorted((v for v in values if v is not None), key=key)
        marks = sorted({key(kept[-(-i * len(kept) // 10) - 1]) for i in range(1, 10)})
        want = {}
        for v in kept:
            want.setdefault(sum(m < key(v) for m in marks), []).append(key(v))
        found = statistics.histogram(spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(5), "v", accuracy=20).collect()
        assert {r.bucket: (key(r.lower_bound), key(r.upper_bound), r.frequency) for r in found} == {k: (x[0], x[-1], len(x)) for k, x in want.items()}


def test_ranges_exclude_scans(spark, demo):
    spec = TableSpec("A", "A", [ColumnSpec("a1", "Int32", [{"RangeStat": {"lower_bound": {"Int32": 1}, "upper_bound": {"Int32": 9}}}])])
    catalog = Catalog(demo.tables, [spec])
    for op, value, none in (("GT", 9, True), ("GTE", 9, False), ("LT", 1, True), ("LTE", 1, False), ("EQ", 10, True), ("EQ", 9, False), ("NE", 99, False)):
        df = compile_query(scan("A").filter("a1", op, i32(value)).build(), catalog)
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, compile_query(scan("A").filter("a1", op, i32(value)).build(), demo).collect()))
        assert ("LocalTableScan <empty>" in df._jdf.queryExecution().optimizedPlan().toString() or "LocalRelation <empty>" in df._jdf.queryExecution().optimizedPlan().toString()) == none


def test_large_sides_are_not_broadcast(spark, demo):
    from lathe.operators.relational import crossed

    a, b = demo.table("A"), spark.range(5).selectExpr("cast(id AS int) AS b1")
    plan = lambda limit: crossed(a, b, "broadcast", limit).where("a1 = b1")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(1 << 20) and "ShuffledHashJoin" in plan(0)


def test_statistics_and_catalog_file(spark, sf_dir, tmp_path):
    spec = statistics.analyze(spark.read.parquet(f"{sf_dir}/nation.parquet"), "nation")
    Catalog(specs=[spec]).save(str(tmp_path / "db.json"))
    assert Catalog.load_specs(str(tmp_path / "db.json")) == [spec]
    key = spec.columns[0]
    assert key.facts()["physically_ordered"] and key.facts()["density"] == 1.0 and key.facts()["cardinality"] == 25
    assert key.facts()["range"] == {"lower_bound": {"Int32": 0}, "upper_bound": {"Int32": 24}}
    assert statistics.sample(spark.range(100), 10).count() == 10 and statistics.sample(spark.range(5), 10).count() == 5


def test_physical_order_over_files(spark, tmp_path):
    for i, ids in enumerate(([1, 2, 2], [3, 5], [4])):
        spark.createDataFrame([(x, str(9 - x)) for x in ids], "a int, s string").coalesce(1).write.parquet(f"{tmp_path}/p{i}")
    of = lambda *n: {r[0]: r[1] for r in statistics.physical_order(spark.read.parquet(*(f"{tmp_path}/p{i}" for i in n)), ["a", "s"]).collect()}
    assert of(0, 1) == {"a": True, "s": False} and of(0, 1, 2)["a"] is False
    spark.createDataFrame([(x, None) for x in (1, None, 2, 5, None)], "a int, s string").coalesce(1).write.parquet(f"{tmp_path}/p3")
    assert of(3) == {"a": True, "s": True}
    spark.createDataFrame([(x, None) for x in (5, None, 4)], "a int, s string").coalesce(1).write.parquet(f"{tmp_path}/p4")
    assert of(4) == {"a": False, "s": True}


def test_merge_hint_from_statistics(spark, demo):
    spec = lambda name, *cs: TableSpec(name, name, [ColumnSpec(c, "Int32", ["IsPhysicallyOrdered", {"DensityStat": 0.5}]) for c in cs])
    catalog = Catalog(demo.tables, [spec("A", "a1"), spec("B", "b1")])
    plan = compile_query(DEMO, catalog, join_hint="auto")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_harness_and_cli(spark, demo, tmp_path, capsys):
    want = tmp_path / "want"
    want.write_text("2|9|\n2|8|\n2|9|\n2|8|\n1|7|\n\n")
    case = {"execution_name": "demo", "query": json.loads(to_json(DEMO)), "expected_output_file": str(want)}
    assert run_cases([QueryCase.of(case)], demo)[0].passed
    want.write_text("1|7|\n2|8|\n2|8|\n2|9|\n2|9|\n")
    assert not run_cases([QueryCase.of(case)], demo)[0].passed
    assert run_cases([QueryCase.of(case | {"sort_before_check": True}), QueryCase.of(case | {"disabled": True})], demo)[0].passed
    data, out = tmp_path / "data", tmp_path / "out"
    data.mkdir()
    for name, kinds, rows in (("A", "a1|a2\nI32|I32", "1|5\n"), ("B", "b1|b2|b3\nI32|I32|I32", "1|7|1\n")):
        (data / f"{name}.schema").write_text(kinds + "\n")
        (data / f"{name}.csv").write_text(rows)
    assert main(["compile-data", str(data), str(out)], spark) == 0
    (tmp_path / "q.json").write_text(to_json(DEMO))
    assert main(["run", str(out), str(tmp_path / "q.json"), "--framed"], spark) == 0
    assert capsys.readouterr().out.split() == ["validate", "1|7|", "!"]
    assert main(["stats", str(out), str(tmp_path / "db.json")], spark) == 0 and Catalog.load_specs(str(tmp_path / "db.json"))
    (tmp_path / "cases.json").write_text(json.dumps([case | {"disabled": True}]))
    assert main(["check", str(out), str(tmp_path / "cases.json")], spark) == 0
    assert main(["explain", str(out), str(tmp_path / "q.json")], spark) == 0
    assert main(["compile-data", str(data), str(out), "--sort", "A.a1", "--catalog", str(tmp_path / "db2.json")], spark) == 0
    assert main(["run", str(out), str(tmp_path / "q.json"), "--catalog", str(tmp_path / "db2.json"), "--join-hint", "auto", "--runtime-filters"], spark) == 0
    assert main(["make-cases", str(out), str(tmp_path / "want2"), str(tmp_path / "cases2.json")], spark) == 0
    assert main(["check", str(out), str(tmp_path / "cases2.json")], spark) == 0
    assert main(["write-blocks", str(out), "A", str(tmp_path / "blocks")], spark) == 0 and list((tmp_path / "blocks").glob("part-*"))


def test_entry_without_the_optional_package(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 851 and len(TEST_TABLES) == 14
    assert isinstance(DEMO.root, object) and T.IntegerType() == T.IntegerType()
