"""One query per operator of the engine, each with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.csv  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlpit.functions.expressions import cast_to, float_div, int_div, lit, user_aggregate
from marlpit.operators import relational as R
from marlpit.plans.explain import explain_rows
from marlpit.plans.result import Result
from marlpit.session import Engine
from marlpit.sources.catalog import RangeSource, from_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
c = F.col


def tab(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def over(name: str, table: str, sql: str):
    """Registers a query over one table under ``name``."""

    def put(build: Callable[[DataFrame], DataFrame]):
        QUERIES[name], SQL[name] = (lambda spark, sf: build(tab(spark, sf, table))), sql
        return build

    return put


def many(name: str, *tables: str, sql: str):
    """Registers a query over several tables."""

    def put(build: Callable[..., DataFrame]):
        QUERIES[name], SQL[name] = (lambda spark, sf: build(*(tab(spark, sf, t) for t in tables))), sql
        return build

    return put


def text(name: str, *tables: str, spark_sql: str, sql: str | None = None):
    """Registers a query given as SQL text, run by ``spark.sql`` over DataFrame arguments."""
    QUERIES[name] = lambda spark, sf: spark.sql(spark_sql, **{t: tab(spark, sf, t) for t in tables})
    SQL[name] = sql or spark_sql.replace("{", "").replace("}", "")


# scans and projections
over("scan_parquet", "nation", "SELECT * FROM nation")(lambda d: d)
over("project_columns", "orders", "SELECT o_orderkey, o_totalprice FROM orders")(lambda d: R.project(d, "o_orderkey", "o_totalprice"))
over("project_star", "supplier", "SELECT * FROM supplier")(lambda d: R.project(d, "*"))
over("project_qualified_star", "region", "SELECT r.* FROM region r")(lambda d: R.project(d.alias("r"), "r.*"))
over("project_alias", "customer", "SELECT c_custkey AS id, c_name AS label FROM customer")(lambda d: R.project(d, c("c_custkey").alias("id"), c("c_name").alias("label")))
over("project_by_index", "customer", "SELECT c_name FROM customer")(lambda d: R.project(d, d[d.columns[1]]))
over("literal_columns", "region", "SELECT r_regionkey, CAST(7 AS BIGINT) AS n, CAST(1.5 AS DOUBLE) AS x, 'abc' AS s, TRUE AS b, CAST(NULL AS BIGINT) AS z FROM region")(
    lambda d: R.project(d, "r_regionkey", lit(7).alias("n"), lit(1.5).alias("x"), lit("abc").alias("s"), lit(True).alias("b"), lit(None).cast("bigint").alias("z"))
)

# predicates
for key, op, make in (
    ("eq", "=", lambda a, b: a == b), ("ne", "<>", lambda a, b: a != b), ("lt", "<", lambda a, b: a < b),
    ("le", "<=", lambda a, b: a <= b), ("gt", ">", lambda a, b: a > b), ("ge", ">=", lambda a, b: a >= b),
):
    over(f"filter_{key}", "part", f"SELECT p_partkey, p_size FROM part WHERE p_size {op} 25")(lambda d, make=make: R.select(d, make(c("p_size"), F.lit(25))).select("p_partkey", "p_size"))
over("filter_string", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")(lambda d: R.select(d, c("o_orderstatus") == "F").select("o_orderkey"))
over("filter_and", "part", "SELECT p_partkey FROM part WHERE NULLIF(p_size, 7) > 5 AND p_retailprice < 1500")(lambda d: R.select(d, F.nullif(c("p_size"), F.lit(7)) > 5, c("p_retailprice") < 1500).select("p_partkey"))
over("filter_or", "part", "SELECT p_partkey FROM part WHERE NULLIF(p_size, 7) > 45 OR p_retailprice < 1200")(lambda d: R.select(d, (F.nullif(c("p_size"), F.lit(7)) > 45) | (c("p_retailprice") < 1200)).select("p_partkey"))
over("filter_not", "part", "SELECT p_partkey FROM part WHERE NOT (NULLIF(p_size, 7) > 10)")(lambda d: R.select(d, ~(F.nullif(c("p_size"), F.lit(7)) > 10)).select("p_partkey"))
over("filter_precedence", "part", "SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 40 AND NOT p_retailprice < 1300")(lambda d: R.select(d, (c("p_size") < 5) | ((c("p_size") > 40) & ~(c("p_retailprice") < 1300))).select("p_partkey"))
over("const_fold_filter", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.0 * (2 + 3) AND TRUE")(lambda d: R.select(d, c("o_totalprice") > lit(1000.0) * (lit(2) + lit(3)), lit(True)).select("o_orderkey"))

# arithmetic and casts
N = "n_nationkey"
over("arith_add", "nation", f"SELECT {N}, {N} + CAST(10 AS BIGINT) AS v FROM nation")(lambda d: d.select(N, (c(N) + lit(10)).alias("v")))
over("arith_sub", "nation", f"SELECT {N}, {N} - CAST(10 AS BIGINT) AS v FROM nation")(lambda d: d.select(N, (c(N) - lit(10)).alias("v")))
over("arith_mul", "nation", f"SELECT {N}, {N} * CAST(3 AS BIGINT) AS v FROM nation")(lambda d: d.select(N, (c(N) * lit(3)).alias("v")))
over("arith_div_int", "nation", f"SELECT {N}, CAST(({N} - 12) AS BIGINT) // NULLIF({N} - 5, 0) AS v FROM nation")(lambda d: d.select(N, int_div(c(N) - lit(12), c(N) - lit(5)).alias("v")))
over("arith_div_float", "customer", "SELECT c_custkey, ROUND(c_acctbal / 7.0, 6) AS v FROM customer")(lambda d: d.select("c_custkey", F.round(float_div(c("c_acctbal"), lit(7.0)), 6).alias("v")))
over("arith_precedence", "nation", f"SELECT {N}, CAST({N} + {N} * 2 - ({N} - 1) * 3 AS BIGINT) AS v FROM nation")(lambda d: d.select(N, (c(N) + c(N) * lit(2) - (c(N) - lit(1)) * lit(3)).alias("v")))
over("unary_minus", "customer", "SELECT c_custkey, -c_custkey AS v FROM customer")(lambda d: d.select("c_custkey", (-c("c_custkey")).alias("v")))
for key, name, duck in (("int", "INT", "CAST(trunc(c_acctbal) AS INT)"), ("bigint", "INTEGER", "CAST(trunc(c_acctbal) AS BIGINT)"), ("float", "FLOAT", "CAST(c_custkey AS FLOAT)"), ("double", "DOUBLE", "CAST(c_custkey AS DOUBLE)"), ("varchar", "VARCHAR", "CAST(c_custkey AS VARCHAR)"), ("boolean", "BOOLEAN", "CAST(c_nationkey AS BOOLEAN)")):
    source = {"int": "c_acctbal", "bigint": "c_acctbal", "boolean": "c_nationkey"}.get(key, "c_custkey")
    over(f"cast_{key}", "customer", f"SELECT c_custkey, {duck} AS v FROM customer")(lambda d, name=name, source=source: d.select("c_custkey", cast_to(c(source), name).alias("v")))

# aggregates
L = "lineitem"
for key, build, duck in (
    ("sum", lambda: F.sum("l_linenumber"), "CAST(SUM(l_linenumber) AS BIGINT)"), ("count", lambda: F.count(F.nullif(c("l_linenumber"), F.lit(2))), "COUNT(NULLIF(l_linenumber, 2))"),
    ("count_star", lambda: F.count(F.lit(1)), "COUNT(*)"), ("min", lambda: F.min("l_extendedprice"), "MIN(l_extendedprice)"),
    ("max", lambda: F.max("l_shipdate"), "MAX(l_shipdate)"), ("avg", lambda: F.round(F.avg("l_linenumber"), 9), "ROUND(AVG(l_linenumber), 9)"),
):
    over(f"agg_{key}", L, f"SELECT l_returnflag, {duck} AS v FROM lineitem GROUP BY l_returnflag")(lambda d, build=build: R.aggregate(d, ["l_returnflag"], [build().alias("v")]))
over("agg_null_group", "part", "SELECT NULLIF(p_size, 7) AS k, COUNT(*) AS n FROM part GROUP BY 1")(lambda d: R.aggregate(d, [F.nullif(c("p_size"), F.lit(7)).alias("k")], [F.count(F.lit(1)).alias("n")]))
over("agg_all_null", "part", "SELECT p_brand, SUM(CAST(NULL AS BIGINT))::BIGINT AS s, COUNT(CAST(NULL AS BIGINT)) AS n FROM part GROUP BY p_brand")(lambda d: R.aggregate(d, ["p_brand"], [F.sum(lit(None).cast("bigint")).alias("s"), F.count(lit(None)).alias("n")]))
over("agg_multi_key", L, "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, COUNT(*) AS n FROM lineitem GROUP BY 1, 2")(lambda d: R.aggregate(d, ["l_returnflag", "l_linestatus"], [F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.count(F.lit(1)).alias("n")]))
over("agg_expr_key", "orders", "SELECT CAST(o_custkey % 10 + 1 AS BIGINT) AS k, COUNT(*) AS n FROM orders GROUP BY 1")(lambda d: R.aggregate(d, [(c("o_custkey") % 10 + 1).alias("k")], [F.count(F.lit(1)).alias("n")]))
over("agg_expr_arg", L, "SELECT l_returnflag, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY 1")(lambda d: R.aggregate(d, ["l_returnflag"], [F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue")]))
over("agg_global", "orders", "SELECT COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders")(lambda d: R.aggregate(d, [], [F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")]))
over("agg_global_empty", "orders", "SELECT COUNT(*) AS n, MAX(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0")(lambda d: R.aggregate(R.select(d, c("o_orderkey") < 0), [], [F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("hi")]))
over("agg_keys_only", "customer", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")(lambda d: R.aggregate(d, ["c_mktsegment", "c_nationkey"], []))
over("agg_duplicate", "orders", "SELECT o_orderstatus, COUNT(*) AS a, COUNT(*) AS b FROM orders GROUP BY 1")(lambda d: R.aggregate(d, ["o_orderstatus"], [F.count(F.lit(1)).alias("a"), F.count(F.lit(1)).alias("b")]))
over("having_agg", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 HAVING COUNT(*) > 12")(lambda d: R.aggregate(d, ["o_custkey"], [F.count(F.lit(1)).alias("n")], having=c("n") > 12))
over("having_key", "orders", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1 HAVING o_orderstatus <> 'F'")(lambda d: R.aggregate(d, ["o_orderstatus"], [F.count(F.lit(1)).alias("n")], having=c("o_orderstatus") != "F"))
over("expr_over_agg", L, "SELECT l_returnflag, COUNT(*) + 1 AS n1, ROUND(SUM(l_quantity) * 2, 2) AS q2 FROM lineitem GROUP BY 1")(lambda d: R.aggregate(d, ["l_returnflag"], [(F.count(F.lit(1)) + 1).alias("n1"), F.round(F.sum("l_quantity") * 2, 2).alias("q2")]))
over("agg_two_phase", L, "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS ln_sum, COUNT(l_linenumber) AS ln_count, AVG(l_linenumber) AS ln_avg FROM lineitem GROUP BY 1")(lambda d: R.two_phase(d, ["l_returnflag"], {"l_linenumber": "ln"}))

over("agg_user", "orders", "SELECT o_orderstatus, MAX(o_custkey) - MIN(o_custkey) AS spread FROM orders GROUP BY 1")(lambda d: R.aggregate(d, ["o_orderstatus"], [user_aggregate(lambda v: int(v.max() - v.min()), "bigint")(c("o_custkey")).alias("spread")]))

# joins
many("join_inner", "customer", "nation", sql="SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")(lambda a, b: R.join(a, b, [("c_nationkey", "n_nationkey")]).select("c_custkey", "n_name"))
many("join_left", "documents", "labels", sql="SELECT d.doc_id, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")(lambda a, b: R.join(a.select("doc_id"), b, [("doc_id", "doc_id")], "left").select("doc_id", "quality"))
many("join_right", "labels", "documents", sql="SELECT d.doc_id, quality FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id")(lambda a, b: R.join(a, b.select("doc_id"), [("doc_id", "doc_id")], "right").select("doc_id", "quality"))
many("join_cross", "region", "nation", sql="SELECT r_name, n_name FROM region CROSS JOIN nation")(lambda a, b: R.join(a, b, how="cross").select("r_name", "n_name"))
text("join_no_on", "region", "nation", spark_sql="SELECT r_regionkey, n_nationkey FROM {region} JOIN {nation}", sql="SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
many("join_no_keys_left", "region", "nation", sql="SELECT r_regionkey, n_nationkey FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 0) ON TRUE")(lambda a, b: R.join(a, b.filter("n_nationkey < 0"), how="left").select("r_regionkey", "n_nationkey"))
many("join_multi_key", "lineitem", "orders", sql="SELECT o_orderkey, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 7 + 1 GROUP BY 1")(
    lambda a, b: R.aggregate(R.join(a.select("l_orderkey", c("l_linenumber").cast("bigint").alias("l")), b.select("o_orderkey", (c("o_custkey") % 7 + 1).alias("o")), [("l_orderkey", "o_orderkey"), ("l", "o")]), ["o_orderkey"], [F.count(F.lit(1)).alias("n")])
)
many("join_three_way", "lineitem", "orders", "customer", sql="SELECT c_mktsegment, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")(
    lambda a, b, d: R.aggregate(R.join(R.join(a, b, [("l_orderkey", "o_orderkey")]), d, [("o_custkey", "c_custkey")]), ["c_mktsegment"], [F.count(F.lit(1)).alias("n")])
)
many("join_same_name", "documents", "labels", sql="SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")(lambda a, b: R.join(a, b, [("doc_id", "doc_id")]).select("doc_id", "lang", "quality"))
over("join_self", "nation", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(lambda d: d.alias("a").join(d.alias("b"), (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("x"), c("b.n_name").alias("y")))
many("join_null_safe", "nation", "region", sql="SELECT n_nationkey, r_name FROM (SELECT *, NULLIF(n_regionkey, 2) AS k FROM nation) JOIN (SELECT *, NULLIF(r_regionkey, 2) AS j FROM region) ON k IS NOT DISTINCT FROM j")(
    lambda a, b: R.join(a.withColumn("k", F.nullif(c("n_regionkey"), F.lit(2))), b.withColumn("j", F.nullif(c("r_regionkey"), F.lit(2))), [("k", "j")], null_safe=True).select("n_nationkey", "r_name")
)
many("join_null_keys", "nation", "region", sql="SELECT n_nationkey, r_name FROM (SELECT *, NULLIF(n_regionkey, 2) AS k FROM nation) LEFT JOIN (SELECT *, NULLIF(r_regionkey, 2) AS j FROM region) ON k = j")(
    lambda a, b: R.join(a.withColumn("k", F.nullif(c("n_regionkey"), F.lit(2))), b.withColumn("j", F.nullif(c("r_regionkey"), F.lit(2))), [("k", "j")], "left").select("n_nationkey", "r_name")
)
many("join_then_agg", "orders", "lineitem", sql="SELECT o_orderpriority, COUNT(l_orderkey) AS n, COUNT(*) AS rows_all FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")(
    lambda a, b: R.aggregate(R.join(a, b, [("o_orderkey", "l_orderkey")], "left"), ["o_orderpriority"], [F.count("l_orderkey").alias("n"), F.count(F.lit(1)).alias("rows_all")])
)

# order, limit, top-k
over("sort_asc", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50")(lambda d: R.top_k(d, 50, ("o_totalprice", True), ("o_orderkey", True)).select("o_orderkey", "o_totalprice"))
over("sort_desc", "part", "SELECT p_partkey, NULLIF(p_size, 50) AS s FROM part ORDER BY s DESC NULLS LAST, p_partkey")(lambda d: R.order(d.select("p_partkey", F.nullif(c("p_size"), F.lit(50)).alias("s")), ("s", False), ("p_partkey", True)))
over("sort_multi", "customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 100")(lambda d: R.top_k(d.select("c_custkey", "c_mktsegment", "c_acctbal"), 100, ("c_mktsegment", True), ("c_acctbal", False), ("c_custkey", True)))
over("sort_expr", "customer", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")(lambda d: R.top_k(d, 20, (F.abs("c_acctbal"), False), ("c_custkey", True)).select("c_custkey"))
over("order_by_agg", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY COUNT(*) DESC, o_custkey LIMIT 15")(lambda d: R.top_k(R.aggregate(d, ["o_custkey"], [F.count(F.lit(1)).alias("n")]), 15, ("n", False), ("o_custkey", True)))
over("sort_asc_whole", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")(lambda d: R.order(d.select("o_orderkey", "o_totalprice"), ("o_totalprice", True), ("o_orderkey", True)))
over("sort_multi_whole", "customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")(lambda d: R.order(d.select("c_custkey", "c_mktsegment", "c_acctbal"), ("c_mktsegment", True), ("c_acctbal", False), ("c_custkey", True)))
over("sort_expr_whole", "customer", "SELECT c_custkey FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey")(lambda d: R.order(d, (F.abs("c_acctbal"), False), ("c_custkey", True)).select("c_custkey"))
over("order_by_agg_whole", "orders", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY COUNT(*) DESC, o_custkey")(lambda d: R.order(R.aggregate(d, ["o_custkey"], [F.count(F.lit(1)).alias("n")]), ("n", False), ("o_custkey", True)))
over("limit_ordered", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")(lambda d: R.limit(R.order(d, ("o_orderkey", True)), 10).select("o_orderkey"))
over("limit_zero", "orders", "SELECT o_orderkey FROM orders LIMIT 0")(lambda d: R.limit(d.select("o_orderkey"), 0))
over("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")(lambda d: R.top_k(d, 25, ("o_totalprice", False), ("o_orderkey", True)).select("o_orderkey", "o_totalprice"))

# SQL text
FLAGSHIP = """SELECT c_mktsegment, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, COUNT(*) AS n
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_discount > 0.02
GROUP BY c_mktsegment HAVING COUNT(*) > 0 ORDER BY revenue DESC NULLS LAST LIMIT 10"""
text("sql_full_pipeline", "customer", "orders", "lineitem", spark_sql=FLAGSHIP)
text("sql_where_group_having", "lineitem", spark_sql="SELECT l_suppkey AS s, COUNT(*) AS n, MIN(l_quantity) AS lo FROM {lineitem} WHERE l_quantity > 10 AND NOT l_returnflag = 'R' GROUP BY l_suppkey HAVING COUNT(*) > 3 -- a comment")
text("sql_group_expr", "orders", spark_sql="SELECT o_custkey % 5 + 1 AS k, COUNT(*) AS n FROM {orders} GROUP BY o_custkey % 5 + 1")
text("sql_left_join", "orders", "lineitem", spark_sql="SELECT o_orderkey, COUNT(l_orderkey) AS n FROM {orders} LEFT JOIN {lineitem} ON o_orderkey = l_orderkey GROUP BY o_orderkey")
text("sql_right_join", "lineitem", "orders", spark_sql="SELECT o_orderkey, COUNT(l_orderkey) AS n FROM {lineitem} RIGHT JOIN {orders} ON o_orderkey = l_orderkey GROUP BY o_orderkey")
text("sql_self_join", "nation", spark_sql="SELECT a.n_name AS x, COUNT(*) AS n FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey GROUP BY a.n_name")

# partitioning
over("repartition_hash", "orders", "SELECT o_orderkey, o_custkey FROM orders")(lambda d: R.hash_partition(d.select("o_orderkey", "o_custkey"), 8, "o_custkey"))
over("repartition_round_robin", "orders", "SELECT o_orderkey, o_custkey FROM orders")(lambda d: R.round_robin(d.select("o_orderkey", "o_custkey"), 8))
over("per_shard_union", "orders", "SELECT o_orderkey % 2 AS shard, COUNT(*) AS n FROM orders GROUP BY 1")(lambda d: R.per_shard([d.filter(c("o_orderkey") % 2 == i) for i in (0, 1)], lambda s: s.groupBy((c("o_orderkey") % 2).alias("shard")).agg(F.count(F.lit(1)).alias("n"))))

over("per_shard_column", "orders", "SELECT CAST(o_orderkey % 3 AS INT) AS shard, COUNT(*) AS n FROM orders GROUP BY 1")(lambda d: R.per_shard([d.filter(c("o_orderkey") % 3 == i) for i in range(3)], lambda s: s.agg(F.count(F.lit(1)).alias("n")), shard="shard"))

# sources and results


def scratch(spark: SparkSession) -> str:
    """A new folder in the warehouse, which driver and executors share."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/marlpit-{uuid.uuid4().hex}"


def whole(name: str, sql: str):
    """Registers a query of (spark, sf)."""

    def put(build: Query):
        QUERIES[name], SQL[name] = build, sql
        return build

    return put


def through_csv(spark: SparkSession, df: DataFrame, delimiter: str) -> DataFrame:
    path = scratch(spark)
    Result(df).write_csv(path, delimiter=delimiter)
    return Engine(spark).csv(path)


def through_file(spark: SparkSession, df: DataFrame) -> DataFrame:
    with tempfile.TemporaryDirectory() as folder:
        Result(df).to_csv(f"{folder}/out.csv")
        return spark.createDataFrame(pa.csv.read_csv(f"{folder}/out.csv"))


def registered(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(spark)
    engine.register_parquet("nations_of_query", f"{sf}/nation.parquet")
    return engine.sql("SELECT n_regionkey, COUNT(*) AS n FROM nations_of_query GROUP BY n_regionkey;")


def custom(spark: SparkSession, sf: str) -> DataFrame:
    spark.dataSource.register(RangeSource)
    return Engine(spark).register_source("numbers_of_query", RangeSource.name(), rows="10", parts="3")


NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
whole("csv_scan", NATION)(lambda spark, sf: through_csv(spark, tab(spark, sf, "nation"), ","))
whole("csv_sniffed", NATION)(lambda spark, sf: through_csv(spark, tab(spark, sf, "nation"), "|"))
whole("adhoc_scan", NATION)(lambda spark, sf: Engine(spark).parquet(f"{sf}/nation.parquet"))
whole("registered_sql", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY 1")(registered)
whole("memory_table", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'x', CAST(0.5 AS DOUBLE)), (2, NULL, 1.5), (NULL, 'z', NULL)) t(a, b, c)")(lambda spark, sf: from_columns(spark, {"a": [1, 2, None], "b": ["x", None, "z"], "c": [0.5, 1.5, None]}))
whole("custom_source", "SELECT range AS n, range * range AS square FROM range(10)")(custom)
over("result_arrow", "supplier", "SELECT * FROM supplier")(lambda d: d.sparkSession.createDataFrame(Result(d).to_arrow()))
over("result_pandas", "part", "SELECT p_partkey, p_name FROM part")(lambda d: d.sparkSession.createDataFrame(Result(d.select("p_partkey", "p_name")).to_pandas()))
over("result_csv", "region", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")(lambda d: through_file(d.sparkSession, d))
over("result_markdown", "region", "SELECT '| r_regionkey | r_name |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")(lambda d: d.sparkSession.createDataFrame([(x,) for x in Result(d).to_markdown().splitlines()], "line string"))
over("result_rows", "orders", "SELECT COUNT(*) AS n, COUNT(*) AS in_batches FROM orders")(lambda d: d.sparkSession.createDataFrame([(Result(d).row_count, sum(b.num_rows for b in Result(d.select("o_orderkey")).batches()))], "n long, in_batches long"))
over("explain", "orders", "SELECT TRUE AS filtered, TRUE AS pushed")(lambda d: explain_rows(d.filter("o_totalprice > 1000").select("o_orderkey"), "formatted").select(c("plan").contains("Filter").alias("filtered"), c("plan").contains("GreaterThan(o_totalprice,1000.0)").alias("pushed")))

# the published benchmark's shapes
over("bench_scan", "orders", "SELECT * FROM orders LIMIT 1000")(lambda d: R.first_rows(d, 1000))
over("bench_scan_ordered", "orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")(lambda d: R.top_k(d, 1000, ("o_orderkey", True)))
over("bench_filter", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 2000")(lambda d: R.select(d, c("o_totalprice") > 2000).select("o_orderkey", "o_totalprice"))
over("bench_aggregate", "orders", "SELECT o_custkey, ROUND(SUM(o_totalprice), 2) AS s, COUNT(*) AS n FROM orders GROUP BY 1")(lambda d: R.aggregate(d, ["o_custkey"], [F.round(F.sum("o_totalprice"), 2).alias("s"), F.count(F.lit(1)).alias("n")]))
over("bench_multi_agg", L, "SELECT l_orderkey, ROUND(SUM(l_quantity), 2) AS q, ROUND(SUM(l_extendedprice), 2) AS p, COUNT(*) AS n FROM lineitem GROUP BY 1")(lambda d: R.aggregate(d, ["l_orderkey"], [F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("p"), F.count(F.lit(1)).alias("n")]))
