"""Generated predicates and orders, with NULLs, must agree with DuckDB row by row."""

import random

import duckdb
from marlpit.sources.catalog import from_columns

DATA = {
    "id": list(range(12)),
    "name": ["fern", "moss", None, "reed", "moss", "sedge", None, "fern", "", "ivy", "moss", "reed"],
    "value": [10, None, 30, -5, 0, 7, 7, None, 1000, -1000, 3, 2],
}


def predicate(rng, depth=0):
    kind = rng.random()
    if depth < 3 and kind < 0.45:
        return f"({predicate(rng, depth + 1)} {rng.choice(['AND', 'OR'])} {predicate(rng, depth + 1)})"
    if depth < 3 and kind < 0.6:
        return f"(NOT {predicate(rng, depth + 1)})"
    op = rng.choice(["=", "<>", "<", "<=", ">", ">="])
    if rng.random() < 0.4:
        return f"name {op} '{rng.choice(['fern', 'moss', 'reed', 'zed', ''])}'"
    left = rng.choice(["value", "id", "value + id", "value * 2 - id", "-value"])
    return f"{left} {op} {rng.randint(-20, 40)}"


def test_predicates(spark):
    rng = random.Random(7)
    found = [predicate(rng) for _ in range(80)]
    columns = ", ".join(f"{p} AS p{i}" for i, p in enumerate(found))
    from_columns(spark, DATA).createOrReplaceTempView("g")
    con = duckdb.connect()
    con.sql("CREATE TABLE g (id BIGINT, name VARCHAR, value BIGINT)")
    con.executemany("INSERT INTO g VALUES (?, ?, ?)", list(zip(*DATA.values(), strict=True)))
    query = f"SELECT id, {columns} FROM g ORDER BY id"
    assert [tuple(r) for r in spark.sql(query).collect()] == con.sql(query).fetchall()


def test_where_limit_order(spark):
    rng = random.Random(8)
    from_columns(spark, DATA).createOrReplaceTempView("g")
    con = duckdb.connect()
    con.sql("CREATE TABLE g (id BIGINT, name VARCHAR, value BIGINT)")
    con.executemany("INSERT INTO g VALUES (?, ?, ?)", list(zip(*DATA.values(), strict=True)))
    for _ in range(12):
        key = rng.choice(["value", "name"])
        query = f"SELECT id, {key} FROM g WHERE {predicate(rng, 1)} ORDER BY {key} {rng.choice(['ASC', 'DESC'])} NULLS LAST, id LIMIT {rng.randint(0, 12)}"
        assert [tuple(r) for r in spark.sql(query).collect()] == con.sql(query).fetchall(), query
