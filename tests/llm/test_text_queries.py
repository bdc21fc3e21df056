"""Text queries with SQL equal DuckDB on the smallest tables; every query runs."""

import os

import pytest

from quernel.llm import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    import duckdb

    df = catalog.queries()[name](spark, SF)
    rows = sorted(tuple(map(str, r)) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in os.listdir(SF):
            con.execute(f"CREATE VIEW {p.split('.')[0]} AS SELECT * FROM '{SF}/{p}'")
        cur = con.execute(sql)
        assert [x[0] for x in cur.description] == df.columns
        assert rows == sorted(tuple(map(str, r)) for r in cur.fetchall())
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
