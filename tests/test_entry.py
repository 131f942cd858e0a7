"""The driver's contract."""

import os

import pytest

import __spark_entry__ as e


def test_names_agree():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 240


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["w", "n", "rk", "share", "coverage"] and df.count() > 0
