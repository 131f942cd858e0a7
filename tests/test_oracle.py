"""Every query with SQL against DuckDB at the smallest scale; all others give rows."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from textloom.plans import all_queries, registry  # noqa: E402, F401
from tools.compare import TABLES, digest, plain  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = con.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = {c: i for i, c in enumerate(rel.columns)}
    assert digest(got) == digest([tuple(plain(r[at[c]]) for c in cols) for r in rel.fetchall()])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
