"""Every core query with SQL equals DuckDB on the smallest tables; the registry holds together."""

import glob
import os

import duckdb
import pytest

from quernel import catalog

SF = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).split('.')[0]} AS SELECT * FROM '{p}'")
    return con


def norm(rows):
    return sorted(tuple(repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    cur = db.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert norm(map(tuple, df.select(*names).collect())) == norm(cur.fetchall())


def test_registry():
    assert set(SQL) <= set(catalog.queries())
