"""Every registered query of the subpackage on the smallest tables, against its SQL if it has one."""

import duckdb
import pytest

from kbcurate.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "labels", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())
