"""Every query of the registry against its SQL, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__
from tesseral.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test data")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def rows(records):
    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert got or name in ORACLE
    if name in ORACLE:
        want = db.sql(ORACLE[name])
        names = sorted(df.columns)
        assert names == sorted(want.columns)
        assert rows([r[n] for n in names] for r in got) == rows([r[want.columns.index(n)] for n in names] for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())
