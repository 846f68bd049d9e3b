"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from orrery.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rel = duck.sql(catalog.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    expected = sorted([plain(r[rel.columns.index(n)]) for n in names] for r in rel.fetchall())
    assert sorted([plain(r[n]) for n in names] for r in df.collect()) == expected


def test_flagship(spark):
    assert catalog.flagship(spark, SF).count() > 0
