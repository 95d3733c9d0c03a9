"""Every plan query against its SQL at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from atelier.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return "null" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(records, columns):
    return sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}/*.parquet" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name not in ORACLE_SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    cur = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(cur.fetchall(), columns)


def test_entry_point():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
