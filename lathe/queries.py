"""One registered query for each operator of the algebra, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions.text import row_text
from lathe.operators import statistics
from lathe.operators.relational import placed
from lathe.plans.builder import MultiPredicateBuilder, MultiProjectBuilder, MultiSortBuilder, QueryBuilder, column, f32, f64, i32, i64, string
from lathe.plans.catalog import Catalog, ColumnSpec, TableSpec, type_name
from lathe.plans.compiler import compile_query, with_runtime_filters
from lathe.plans.ir import from_json, to_json
from lathe.sources.pipe import read_pipe, write_pipe
from lathe.sources.shared import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

scan = QueryBuilder.scan


def cols(q: QueryBuilder, *names: str, **renamed: str) -> QueryBuilder:
    """Projects plain names, and old names to new ones."""
    pairs = [*((n, n) for n in names), *renamed.items()]
    out = MultiProjectBuilder(*pairs[0])
    for p in pairs[1:]:
        out.add(*p)
    return q.project_multiple(out)


def where(q: QueryBuilder, *tests: tuple) -> QueryBuilder:
    out = MultiPredicateBuilder(*tests[0])
    for t in tests[1:]:
        out.add(*t)
    return q.filter_multiple(out)


def by(q: QueryBuilder, *keys: tuple[str, bool]) -> QueryBuilder:
    out = MultiSortBuilder(*keys[0])
    for k in keys[1:]:
        out.add(*k)
    return q.sort_multiple(out)


def tree(name: str, q: QueryBuilder, sql: str, hint: str | None = None, semantics: str = "spark", analyzed: str | None = None, runtime_filters: bool = False) -> None:
    """Registers a tree. It goes through its JSON form, as a query from outside would.

    ``analyzed`` names a table whose statistics are found first and given to the compiler.
    """
    text = to_json(q.build())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog = Catalog.of_parquet(spark, sf_dir)
        if analyzed:
            catalog.specs[analyzed] = statistics.analyze(catalog.table(analyzed), analyzed)
        out = compile_query(from_json(text), catalog, semantics, hint)
        return with_runtime_filters(out) if runtime_filters else out

    QUERIES[name], ORACLE_SQL[name] = run, sql


def ordered(name: str, q: QueryBuilder, sql: str) -> None:
    """Registers a sorted tree with each row's place in the result, so that the order itself is compared."""
    text = to_json(q.build())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return placed(compile_query(from_json(text), Catalog.of_parquet(spark, sf_dir)))

    QUERIES[name], ORACLE_SQL[name] = run, sql


# Scans
tree("scan_all", scan("nation"), "SELECT * FROM nation")
tree("scan_pruned", cols(scan("lineitem"), "l_orderkey", "l_quantity", "l_returnflag"), "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
tree("scan_pushed_filter", cols(scan("part").filter("p_size", "GTE", i32(40)), "p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size >= 40")
tree("scan_range_prune_empty", cols(scan("part").filter("p_size", "GT", i32(100000)), "p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size > 100000")
tree("scan_ordered_point", cols(scan("orders").filter("o_orderkey", "EQ", i64(77)), "o_orderkey", "o_custkey", "o_totalprice"), "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
tree("scan_ordered_range", cols(where(scan("orders"), ("o_orderkey", "GTE", i64(100)), ("o_orderkey", "LT", i64(500))), "o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 500")

# Filters
for _name, _sql in {"EQ": "=", "NE": "<>", "GT": ">", "GTE": ">=", "LT": "<", "LTE": "<="}.items():
    tree(f"filter_{_name.lower()}", cols(scan("customer").filter("c_nationkey", _name, i32(7)), "c_custkey", "c_name", "c_nationkey"), f"SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey {_sql} 7")
tree("filter_col_col", cols(scan("lineitem").filter("l_tax", "GT", column("l_discount")), "l_orderkey", "l_linenumber", "l_tax", "l_discount"), "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount")
tree("filter_and_multi", cols(where(scan("customer"), ("c_acctbal", "GT", f64(0.0)), ("c_mktsegment", "EQ", string("BUILDING")), ("c_nationkey", "LTE", i32(12))), "c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING' AND c_nationkey <= 12")
tree("filter_stacked", cols(scan("customer").filter("c_acctbal", "GT", f64(0.0)).filter("c_nationkey", "NE", i32(3)), "c_custkey", "c_nationkey"), "SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0 AND c_nationkey <> 3")
tree(
    "filter_typed_literals",
    cols(where(scan("part"), ("p_size", "GTE", i32(5)), ("p_partkey", "GT", i64(10)), ("p_retailprice", "LT", f64(1500.5)), ("p_size", "LT", f32(40.5)), ("p_brand", "NE", string("Brand#11"))), "p_partkey", "p_size", "p_brand"),
    "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size >= 5 AND p_partkey > 10 AND p_retailprice < 1500.5 AND p_size < 40.5 AND p_brand <> 'Brand#11'",
)
tree("filter_mixed_numeric", cols(where(scan("part"), ("p_size", "LT", column("p_retailprice")), ("p_partkey", "GT", column("p_size"))), "p_partkey", "p_size"), "SELECT p_partkey, p_size FROM part WHERE p_size < p_retailprice AND p_partkey > p_size")
tree("filter_type_mismatch", cols(scan("customer").filter("c_name", "NE", i32(5)), "c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE TRUE")
tree("filter_type_mismatch_eq", cols(scan("customer").filter("c_name", "EQ", i32(5)), "c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE FALSE")
tree("filter_iso_date", cols(scan("orders").filter("o_orderdate", "GTE", string("1997-01-01")), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")

# Projections
tree("project_rename", cols(scan("orders"), o_orderkey="id", o_totalprice="price"), "SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
tree("project_identity", cols(scan("nation"), "n_nationkey", "n_name", "n_regionkey"), "SELECT n_nationkey, n_name, n_regionkey FROM nation")
tree("project_subset", cols(scan("part"), "p_partkey", "p_type"), "SELECT p_partkey, p_type FROM part")
tree("project_reorder", cols(scan("part"), "p_size", "p_partkey"), "SELECT p_size, p_partkey FROM part")
tree("project_duplicate", scan("part").project_multiple(MultiProjectBuilder("p_partkey", "a").add("p_partkey", "b").add("p_size", "c")), "SELECT p_partkey AS a, p_partkey AS b, p_size AS c FROM part")

# Joins
_SNR = scan("supplier").cross(scan("nation")).cross(scan("region"))
tree("cross_join", scan("nation").cross(scan("region")), "SELECT * FROM nation CROSS JOIN region")
tree("cross_join_large", cols(_SNR, "s_suppkey", "n_name", "r_name"), "SELECT s_suppkey, n_name, r_name FROM supplier, nation, region")
tree("cross_join_partitioned", cols(_SNR, "s_suppkey", "n_name", "r_name"), "SELECT s_suppkey, n_name, r_name FROM supplier, nation, region", "shuffle_replicate_nl")
tree("join_disconnected", cols(scan("orders").cross(scan("region")).cross(scan("customer")).filter("o_custkey", "EQ", column("c_custkey")), "o_orderkey", "c_name", "r_name"), "SELECT o_orderkey, c_name, r_name FROM orders, region, customer WHERE o_custkey = c_custkey")
tree("join_theta", cols(scan("nation").cross(scan("region")).filter("n_regionkey", "LT", column("r_regionkey")), "n_name", "r_name"), "SELECT n_name, r_name FROM nation, region WHERE n_regionkey < r_regionkey")
_LO = scan("lineitem").cross(scan("orders")).filter("l_orderkey", "EQ", column("o_orderkey"))
_LO_SQL = "SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice FROM lineitem, orders WHERE l_orderkey = o_orderkey"
for _name, _hint in {"join_inner_equi": None, "join_hash": "broadcast", "join_hash_shuffle": "shuffle_hash", "join_sort_merge": "merge"}.items():
    _q = _LO if _hint != "broadcast" else scan("lineitem").cross(scan("supplier")).filter("l_suppkey", "EQ", column("s_suppkey"))
    if _hint == "broadcast":
        tree(_name, cols(_q, "l_orderkey", "l_linenumber", "s_name"), "SELECT l_orderkey, l_linenumber, s_name FROM lineitem, supplier WHERE l_suppkey = s_suppkey", "broadcast")
    else:
        tree(_name, cols(_q, "l_orderkey", "l_linenumber", "l_quantity", "o_totalprice"), _LO_SQL, _hint)
tree("join_dynamic_filter", cols(_LO.filter("o_orderpriority", "EQ", string("1-URGENT")), "l_orderkey", "l_linenumber", "o_totalprice"), "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem, orders WHERE l_orderkey = o_orderkey AND o_orderpriority = '1-URGENT'", runtime_filters=True)
_O1, _O2 = (cols(scan("orders"), o_orderkey=f"{a}.o_orderkey", o_totalprice=f"{a}.o_totalprice") for a in "ab")
tree(
    "join_auto",
    cols(_O1.cross(_O2).filter("a.o_orderkey", "EQ", column("b.o_orderkey")), **{"a.o_orderkey": "k", "b.o_totalprice": "price"}),
    "SELECT a.o_orderkey AS k, b.o_totalprice AS price FROM orders a, orders b WHERE a.o_orderkey = b.o_orderkey", "auto", analyzed="orders",
)
tree("scan_range_prune_stats", cols(scan("orders").filter("o_orderkey", "LT", i64(-5)), "o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderkey < -5", analyzed="orders")
tree(
    "join_multiway_3",
    cols(where(scan("customer").cross(scan("orders")).cross(scan("lineitem")), ("c_custkey", "EQ", column("o_custkey")), ("o_orderkey", "EQ", column("l_orderkey")), ("c_mktsegment", "EQ", string("BUILDING"))), "c_name", "o_orderkey", "l_linenumber", "l_extendedprice"),
    "SELECT c_name, o_orderkey, l_linenumber, l_extendedprice FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND c_mktsegment = 'BUILDING'",
)
tree(
    "join_multiway_6",
    cols(
        where(
            scan("customer").cross(scan("orders")).cross(scan("lineitem")).cross(scan("supplier")).cross(scan("nation")).cross(scan("region")),
            ("c_custkey", "EQ", column("o_custkey")), ("l_orderkey", "EQ", column("o_orderkey")), ("l_suppkey", "EQ", column("s_suppkey")),
            ("c_nationkey", "EQ", column("s_nationkey")), ("s_nationkey", "EQ", column("n_nationkey")), ("n_regionkey", "EQ", column("r_regionkey")),
        ),
        "c_custkey", "o_orderkey", "l_linenumber", "s_suppkey", "n_name", "r_name",
    ),
    "SELECT c_custkey, o_orderkey, l_linenumber, s_suppkey, n_name, r_name FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey",
)
tree(
    "join_out_of_order",
    cols(where(scan("region").cross(scan("customer")).cross(scan("nation")), ("c_nationkey", "EQ", column("n_nationkey")), ("n_regionkey", "EQ", column("r_regionkey"))), "c_custkey", "n_name", "r_name"),
    "SELECT c_custkey, n_name, r_name FROM region, customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey",
)
_L1 = cols(scan("lineitem"), l_orderkey="a.l_orderkey", l_linenumber="a.l_linenumber", l_partkey="a.l_partkey")
_L2 = cols(scan("lineitem"), l_orderkey="b.l_orderkey", l_linenumber="b.l_linenumber", l_partkey="b.l_partkey")
tree(
    "join_composite_key",
    cols(where(_L1.cross(_L2), ("a.l_orderkey", "EQ", column("b.l_orderkey")), ("a.l_linenumber", "EQ", column("b.l_linenumber"))), **{"a.l_orderkey": "k", "a.l_linenumber": "n", "a.l_partkey": "p", "b.l_partkey": "q"}),
    "SELECT a.l_orderkey AS k, a.l_linenumber AS n, a.l_partkey AS p, b.l_partkey AS q FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
)
tree("join_equi_plus_theta", cols(_LO.filter("l_shipdate", "LT", column("o_orderdate")), "l_orderkey", "l_linenumber"), "SELECT l_orderkey, l_linenumber FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate")
_N1, _N2 = (cols(scan("nation"), n_nationkey=f"{a}.n_nationkey", n_regionkey=f"{a}.n_regionkey", n_name=f"{a}.n_name") for a in ("n1", "n2"))
tree(
    "self_join_renamed",
    cols(where(_N1.cross(_N2), ("n1.n_regionkey", "EQ", column("n2.n_regionkey")), ("n1.n_nationkey", "LT", column("n2.n_nationkey"))), **{"n1.n_name": "left_name", "n2.n_name": "right_name"}),
    "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
)
tree("join_mixed_key_types", cols(scan("part").cross(scan("supplier")).filter("p_size", "EQ", column("s_suppkey")), "p_partkey", "s_name"), "SELECT p_partkey, s_name FROM part, supplier WHERE p_size = s_suppkey")

# Sorts
ordered("sort_single_int", by(cols(scan("orders"), "o_orderkey", "o_custkey"), ("o_orderkey", False)), "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders")
ordered("sort_single_float", by(cols(scan("part"), "p_retailprice"), ("p_retailprice", True)), "SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) AS place FROM part")
ordered("sort_string", by(cols(scan("part"), "p_name", "p_partkey"), ("p_name", True), ("p_partkey", True)), "SELECT p_name, p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part")
ordered("sort_multi_mixed", by(cols(scan("orders"), "o_orderstatus", "o_totalprice", "o_orderkey"), ("o_orderstatus", True), ("o_totalprice", False), ("o_orderkey", True)), "SELECT o_orderstatus, o_totalprice, o_orderkey, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM orders")
ordered("sort_large", by(cols(scan("lineitem"), "l_extendedprice", "l_orderkey", "l_linenumber"), ("l_extendedprice", True), ("l_orderkey", False), ("l_linenumber", True)), "SELECT l_extendedprice, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey DESC, l_linenumber) AS place FROM lineitem")
ordered("sort_already_ordered", by(by(cols(scan("customer"), "c_custkey", "c_name"), ("c_name", True)), ("c_custkey", True)), "SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS place FROM customer")

# The flagship: all five nodes
_ALL = [("l_orderkey", True), ("l_linenumber", True), ("l_quantity", False), ("o_totalprice", True), ("l_partkey", True)]
FLAGSHIP = cols(by(where(_LO, ("l_quantity", "GTE", f64(30.0)), ("o_orderstatus", "EQ", string("F"))), *_ALL), *(n for n, _ in _ALL))
ordered("flagship", FLAGSHIP, "SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity DESC, o_totalprice, l_partkey) AS place FROM lineitem, orders WHERE l_orderkey = o_orderkey AND l_quantity >= 30 AND o_orderstatus = 'F'")


# Sources, sinks and statistics
def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@registered("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def source_pipe_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as pipe-delimited text, and read back by its schema."""
    df = Catalog.of_parquet(spark, sf_dir).table("part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    path = shared_folder(spark)
    write_pipe(df, path)
    return read_pipe(spark, path, TableSpec("part", "part", [ColumnSpec(f.name, type_name(f.dataType)) for f in df.schema]))


_P = "printf('%.15g', p_retailprice)"


@registered(f"SELECT p_partkey || '|' || p_name || '|' || {_P} || CASE WHEN contains({_P}, '.') OR contains({_P}, 'e') THEN '' ELSE '.0' END || '|' AS value FROM part")
def sink_pipe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_text(Catalog.of_parquet(spark, sf_dir).table("part").select("p_partkey", "p_name", "p_retailprice"))


_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
_FACTS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _each(columns: list[str], select: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {select.format(c=c)} FROM orders" for c in columns)


@registered(_each(_COLUMNS, "CAST(min({c}) AS VARCHAR) AS lower_bound, CAST(max({c}) AS VARCHAR) AS upper_bound"))
def stats_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.ranges(Catalog.of_parquet(spark, sf_dir).table("orders"), _COLUMNS)


@registered(_each(_FACTS, "count(DISTINCT {c}) AS cardinality"))
def stats_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.cardinality(Catalog.of_parquet(spark, sf_dir).table("orders"), _FACTS)


@registered(_each(_FACTS, "least(1.0, CAST(count(DISTINCT {c}) AS DOUBLE) / count(*)) AS density"))
def stats_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.density(Catalog.of_parquet(spark, sf_dir).table("orders"), _FACTS)


@registered(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, coalesce(bool_and(ok), true) AS physically_ordered FROM (SELECT {c} >= lag({c}) OVER (ORDER BY n) AS ok FROM (SELECT {c}, row_number() OVER () AS n FROM orders))" for c in _FACTS
    )
)
def stats_physical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.physical_order(Catalog.of_parquet(spark, sf_dir).table("orders"), _FACTS)


_TENTHS = ", ".join(str(i / 10) for i in range(1, 10))


@registered(
    f"""
    WITH marks AS (SELECT list_distinct(quantile_disc(o_totalprice, [{_TENTHS}])) AS m FROM orders)
    SELECT CAST(len(list_filter(m, lambda x: x < o_totalprice)) AS INTEGER) AS bucket,
           min(o_totalprice) AS lower_bound, max(o_totalprice) AS upper_bound, count(*) AS frequency
    FROM orders, marks GROUP BY 1
    """
)
def stats_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(Catalog.of_parquet(spark, sf_dir).table("orders"), "o_totalprice")


_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]


@registered(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, TRUE AS sketch_is_close FROM lineitem" for c in _KEYS))
def stats_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketch beside exact counts: it must be within 6 %, some three and a half standard deviations."""
    table = Catalog.of_parquet(spark, sf_dir).table("lineitem")
    exact = statistics.cardinality(table, _KEYS).withColumnRenamed("cardinality", "distinct_values")
    both = exact.join(statistics.approx_distinct(table, _KEYS), "column_name")
    close = F.abs(F.col("cardinality") - F.col("distinct_values")) <= 0.06 * F.col("distinct_values")
    return both.select("column_name", "distinct_values", close.alias("sketch_is_close"))
