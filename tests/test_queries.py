"""Every graph query against its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from graphloom.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "pagerank_converged"])
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        want = db.sql(ORACLE_SQL[name]).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        one, two = (df[columns].sort_values(columns).reset_index(drop=True) for df in (got, want))
        pd.testing.assert_frame_equal(one, two, check_dtype=False, rtol=1e-9)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
