import os

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert rows
    if name in ORACLE:
        rel = duck.sql(ORACLE[name])
        assert sorted(rel.columns) == sorted(df.columns)
        order = [rel.columns.index(c) for c in sorted(df.columns)]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
