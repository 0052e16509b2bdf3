"""The queries against their SQL, and that every query runs over the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from marlpit.llm import queries

from tests.conftest import SF
from tests.test_catalogue import rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    have = df.collect()
    assert "fixity" in name or len(have) == 200
    if name in queries.SQL:
        con = duckdb.connect()
        for p in Path(SF).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.sql(queries.SQL[name])
        assert rows(df.columns, have) == rows(want.columns, want.fetchall())
