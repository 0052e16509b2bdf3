"""The facade, sources, results, shell and plan shapes."""

import io
import os
import subprocess
import sys

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from marlpit.cli import Shell
from marlpit.functions.expressions import cast_to, float_div, int_div, lit
from marlpit.operators import relational as R
from marlpit.plans.explain import explain_rows, plan_text
from marlpit.plans.result import Result
from marlpit.session import Engine
from marlpit.sources import catalog
from marlpit.streaming import catch_up
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tests.conftest import SF


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.register_memory("t", {"id": [11, 12, 13, 14], "name": ["fern", "moss", "fern", "reed"], "value": [7, 70, 700, 5]})
    return e


def test_registry(engine):
    assert engine.tables() == ["t"]
    assert [f.name for f in engine.table_schema("t")] == ["id", "name", "value"]
    with pytest.raises(ValueError, match="Unknown table: nope"):
        engine.table("nope")
    engine.register_table("t", engine.table("t").limit(1))
    assert engine.tables() == ["t"] and engine.table("t").count() == 1


def test_sql_standard_meaning(engine):
    rows = lambda q: [tuple(r) for r in engine.sql(q).collect()]
    assert rows("SELECT name, SUM(value) * 2 AS s FROM t GROUP BY name HAVING COUNT(*) > 1 ORDER BY s;") == [("fern", 1414)]
    assert rows("SELECT name FROM t GROUP BY name ORDER BY SUM(value) DESC, name") == [("fern",), ("moss",), ("reed",)]
    assert rows("SELECT a.id FROM t a LEFT JOIN t b ON a.id = b.id + 2 WHERE b.id IS NULL ORDER BY a.id") == [(11,), (12,)]
    with pytest.raises(ValueError, match="Unknown table: nowhere"):
        engine.sql("SELECT * FROM nowhere")
    assert rows("SELECT COUNT(*) AS n, SUM(id) AS s FROM t WHERE id > 99") == [(0, None)]


def test_explain(engine):
    rows = engine.sql("EXPLAIN SELECT id FROM t WHERE value > 20").collect()
    assert len(rows) == 1 and list(rows[0].asDict()) == ["plan"]
    assert explain_rows(engine.sql("SELECT id FROM t")).columns == ["plan"]


def test_plans_prune_and_push(spark):
    df = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan_text(df.filter("o_totalprice > 1000").select("o_orderkey", "o_totalprice"))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "o_custkey" not in text.split("ReadSchema")[1].split("\n")[0]
    assert "TakeOrderedAndProject" in plan_text(R.top_k(df, 5, ("o_totalprice", False)), "simple")
    assert "SortMergeJoin" not in plan_text(R.join(df, spark.read.parquet(f"{SF}/nation.parquet"), [("o_custkey", "n_nationkey")]), "simple")


@pytest.mark.parametrize("sep", [",", "\t", "|", ";"])
def test_csv(engine, tmp_path, sep):
    path = tmp_path / "x.csv"
    path.write_text(sep.join(["id", "name", "v"]) + "\n" + sep.join(["1", "al", "10.5"]) + "\n" + sep.join(["2", "", "20.25"]) + "\n")
    df = engine.register_csv("c", str(path))
    assert [f.dataType.simpleString() for f in df.schema] == ["int", "string", "double"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(1, "al", 10.5), (2, None, 20.25)]
    kept = catalog.read_csv(engine.spark, str(path), sep, empty_as_null=False)
    assert kept.filter("id = 2").first().name == ""


def test_memory_and_custom_sources(engine, spark):
    assert catalog.from_columns(spark, {"a": [None, None]}).schema["a"].dataType == StringType()
    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    assert catalog.from_columns(spark, {"a": [], "b": []}, schema).schema == schema
    spark.dataSource.register(catalog.RangeSource)
    df = engine.register_source("squares", "marlpit_range", rows="7", parts="3")
    assert sorted(tuple(r) for r in df.collect()) == [(i, i * i) for i in range(7)]


def test_results(engine, tmp_path, capsys):
    out = engine.run("SELECT id, name FROM t ORDER BY id")
    assert out.row_count == 4 and isinstance(out.to_arrow(), pa.Table) and list(out.to_pandas().columns) == ["id", "name"]
    assert engine.run("SELECT id FROM t WHERE id > 9").to_arrow().schema.names == ["id"]
    out.to_csv(tmp_path / "o.csv")
    assert (tmp_path / "o.csv").read_text().splitlines()[:2] == ["id,name", "11,fern"]
    out.write_csv(str(tmp_path / "dir"))
    assert engine.csv(str(tmp_path / "dir")).count() == 4
    assert out.to_markdown().splitlines()[:3] == ["| id | name |", "| --- | --- |", "| 11 | fern |"] and len(out.to_markdown().splitlines()) == 6
    assert Result(out.df.limit(0)).to_markdown().splitlines() == ["| id | name |", "| --- | --- |"]
    assert "only the first" not in out.to_markdown(4) and len(engine.run("SELECT id FROM range(3000)").to_markdown().splitlines()) == 3002
    out.show(2)
    assert "only the first 2 rows" in capsys.readouterr().out


def test_expressions(spark):
    df = spark.createDataFrame([(7, 2), (-7, 2), (7, 0), (None, 1)], "a long, b long")
    assert [r[0] for r in df.select(int_div(F.col("a"), F.col("b"))).collect()] == [3, -3, None, None]
    assert [r[0] for r in df.select(float_div(F.col("a"), F.col("b"))).collect()] == [3.5, -3.5, None, None]
    assert df.select(lit(1), lit(1.5), lit(True), lit("x")).dtypes == [("CAST(1 AS BIGINT)", "bigint"), ("1.5", "double"), ("true", "boolean"), ("x", "string")]
    assert spark.range(1).select(cast_to(F.lit(2.7), "integer").alias("x")).dtypes == [("x", "bigint")]
    with pytest.raises(ValueError):
        cast_to(F.lit(1), "decimal")


def test_null_and_nan_order(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (5.0,)], "x double")
    got = lambda asc: [str(r[0]) for r in R.order(df, ("x", asc)).collect()]
    assert got(True) == ["1.0", "5.0", "nan", "None"] and got(False) == ["5.0", "1.0", "nan", "None"]


def test_joins_on_nulls(spark):
    a, b = (spark.createDataFrame([(1, "x"), (None, "n")], f"k int, {c} string") for c in "vw")
    assert R.join(a, b, [("k", "k")]).count() == 1
    assert R.join(a, b, [("k", "k")], null_safe=True).count() == 2
    assert R.join(a, b, [("k", "k")], "full").count() == 3
    assert R.join(a, b, how="cross").count() == 4 and R.join(a, b, [("k", "k")], "anti").count() == 1
    both = R.join(a, b, [("k", "k")], "full", null_safe=True)
    assert both.columns == ["k", "v", "w"] and {tuple(r) for r in both.collect()} == {(1, "x", "x"), (None, "n", "n")}
    some = R.join(a.filter("k = 1"), b, [("k", "k")], "right", null_safe=True)
    assert {tuple(r) for r in some.collect()} == {(1, "x", "x"), (None, None, "n")}


def test_joins_without_keys(spark):
    a, none = spark.createDataFrame([(1,), (2,)], "x int"), spark.createDataFrame([], "y int")
    rows = lambda l, r, how: sorted(tuple(x) for x in R.join(l, r, how=how).collect())  # noqa: E731, E741
    assert rows(a, none, "left") == [(1, None), (2, None)] == rows(a, none, "full") and rows(a, none, "inner") == []
    assert rows(none, a, "right") == [(None, 1), (None, 2)] and rows(a, none, "anti") == [(1,), (2,)] and rows(a, none, "semi") == []
    assert len(rows(a, a.withColumnRenamed("x", "y"), "left")) == 4


def test_first_rows(spark, tmp_path):
    """In stored order over several files, row groups and tasks, for any number of rows; a column may have the metadata's name."""
    for i, n in enumerate((7, 0, 4000, 9)):
        path = str(tmp_path / f"t-{i}.parquet")
        pq.write_table(pa.table({"_metadata": pa.array([i] * n, pa.int64()), "at": pa.array(range(n, 0, -1), pa.int64())}), path, row_group_size=100)
    whole = [(i, at) for i, n in enumerate((7, 0, 4000, 9)) for at in range(n, 0, -1)]
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = spark.read.parquet(str(tmp_path))
        assert df.rdd.getNumPartitions() > 4
        for n in (0, 1, 7, 8, 350, 4007, 4008, 9000):
            assert [tuple(r) for r in R.first_rows(df, n).collect()] == whole[:n]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_two_phase_equals_one(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 5), (None, 7), ("a", 4)], "k string, v int")
    two = {tuple(r) for r in R.two_phase(df, ["k"], {"v": "v"}).collect()}
    assert two == {tuple(r) for r in df.groupBy("k").agg(F.sum("v"), F.count("v"), F.avg("v")).collect()}
    wide = R.two_phase(spark.read.parquet(f"{SF}/lineitem.parquet"), ["l_returnflag"], {"l_linenumber": "n"})
    assert "l_quantity" not in plan_text(wide).split("ReadSchema")[1].split("\n")[0]


def test_streaming(spark, tmp_path):
    """Files that came since are added once."""
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    for n in (3, 5):
        spark.range(n).write.mode("append").parquet(source)
        for _ in range(2):
            catch_up(spark, source, target, f"{tmp_path}/seen", lambda d: R.select(d, F.col("id") > 0))
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 1, 2, 2, 3, 4]


def test_partitioning(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    assert R.round_robin(df, 5).rdd.getNumPartitions() == 5
    hashed = R.hash_partition(df, 5, "k").withColumn("p", F.spark_partition_id())
    assert hashed.groupBy("k").agg(F.count_distinct("p").alias("n")).filter("n > 1").count() == 0


def test_shell(engine):
    out = io.StringIO()
    shell = Shell(engine, out)
    for line in (".tables", ".schema t", "SELECT name -- a comment", "FROM t WHERE id = 14;", ".schema nope", "SELECT nope FROM t;", ".help"):
        assert shell.feed(line)
    assert not shell.feed(".quit")
    text = out.getvalue()
    assert "value: bigint" in text and "reed" in text and "Unknown table" in text and text.count("Error") == 2


def test_entry_without_corpus_operators():
    """The entry module imports and the other queries stay when the corpus operators are gone."""
    code = "import sys; sys.modules['marlpit.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
