"""The training-data queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from genlex.llm import oracle, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_twin(spark, name):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        db.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    cur = db.execute(oracle.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())
