"""Every query against its SQL in DuckDB."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from marlpit.plans import catalogue

from tests.conftest import SF


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(canon(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.SQL[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["sort_asc", "sort_multi", "sort_expr", "order_by_agg"])
def test_whole_sorts(spark, duck, name):
    """Besides the capped sorts there is one of the whole table, in the order of its SQL."""
    df = catalogue.QUERIES[f"{name}_whole"](spark, SF)
    want = duck.sql(catalogue.SQL[f"{name}_whole"])
    assert [tuple(canon(x) for x in r) for r in df.collect()] == [tuple(canon(x) for x in r) for r in want.fetchall()]
    assert "LIMIT" not in catalogue.SQL[f"{name}_whole"] and df.columns == want.columns


def test_scan_in_stored_order(spark, duck, tmp_path):
    """The rows of a LIMIT without an order are the first of the first files, not those of the largest."""
    folder, at = tmp_path / "orders.parquet", 0
    folder.mkdir()
    for name, n in (("a 1", 300), ("a+1", 0), ("a-1", 500), ("a1", 700)):
        duck.sql(f"COPY (SELECT * FROM '{SF}/orders.parquet' LIMIT {n} OFFSET {at}) TO '{folder / name}.parquet' (FORMAT parquet)")
        at += n
    df = catalogue.QUERIES["bench_scan"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{folder}/*.parquet'")
    want = con.sql(catalogue.SQL["bench_scan"]).fetchall()
    assert len(want) == 1000 and [tuple(r) for r in df.collect()] == want
    df.write.parquet(str(tmp_path / "out"))
    assert rows(df.columns, spark.read.parquet(str(tmp_path / "out")).collect()) == rows(df.columns, want)
