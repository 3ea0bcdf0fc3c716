import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    assert {f"p{n}_found" for n in (4, 5, 6, 7)} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
