"""Every query that SQL can express gives on the smallest tables what DuckDB gives."""

import os

import duckdb
import pytest

from tessella.plans import code, corpus, graph, ingest, operations, oracles

SF = "/root/testdata/sf0.001"
PARTS = [corpus, graph, ingest, operations, code]
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: (QUERIES[name], sql) for part in [*PARTS, oracles] for name, sql in part.ORACLES.items()}
ONLY = [name for name in QUERIES if name not in ORACLES]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def key(row):
    return tuple((x is not None, str(x)) for x in row)


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, duck, name):
    query, sql = ORACLES[name]
    df, expected = query(spark, SF), duck.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    got = sorted((tuple(r) for r in df.select(columns).collect()), key=key)
    assert got == sorted((tuple(r[i] for i in at) for r in expected.fetchall()), key=key)


@pytest.mark.parametrize("name", ONLY)
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).collect() is not None
