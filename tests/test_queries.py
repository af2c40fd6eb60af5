"""Every registered query against its SQL, on the smallest bundled tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from kbcurate.plans.registry import QUERIES  # noqa: E402
from kbcurate.plans.views import TABLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_id", "type"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got
    if name in entry.oracle_sql():
        result = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert got == sorted(repr(tuple(r[i] for i in order)) for r in result.fetchall())


def test_page_text_leaves_references_without_semicolon(spark, tmp_path):
    rows = [(0, "u", "<title>a&amp;&lt;b&amp</title><p>&copy;&nbsp;&quot;c&quot; &#39;&copy</p>"), (1, "u", "<p>&amp")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["page_text"]).fetchall())
    assert want == [(0, "a&<b&amp © \"c\" '&copy"), (1, "&amp")]
    assert sorted(map(tuple, entry.queries()["page_text"](spark, str(tmp_path)).collect())) == want
