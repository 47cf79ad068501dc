"""Every query runs at the smallest size, and agrees with its SQL where it has one."""

import pytest

import __spark_entry__ as entry
from tests.compare import duck, rows_of

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def test_names():
    assert set(SQL) <= set(QUERIES)
    for n in (1, 2, 3, 5, 6, 7):
        assert f"p{n}_found" in QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck(sf).execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
