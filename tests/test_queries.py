"""Every registered query against its SQL on the smallest tables, and the shape of its plan."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()

# Results that may be empty on the smallest tables.
MAY_BE_EMPTY = {"exclude_multi_attr", "keyword_entries", "missing_ids"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    got, columns = rows_of(df.columns, df.collect())
    assert got or name in MAY_BE_EMPTY
    if name in SQL:
        res = duck.execute(SQL[name])
        want, names = rows_of([d[0] for d in res.description], res.fetchall())
        assert columns == names
        assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["entry_id", "version_x", "version_y", "addition_rate", "deletion_rate", "edit_rate"]
    assert df.count() > 0
