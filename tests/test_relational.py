"""Every registered query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal

import duckdb
import pytest

from tidemark.plans import registry, relational

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def panel(spark):
    """The panel that most queries start from, kept once."""
    kept = relational.returns(spark, SF).persist()
    kept.count()
    yield
    kept.unpersist()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, datetime.datetime):
        return str(v.date())
    if isinstance(v, datetime.date):
        return str(v)
    return float(v) + 0.0 if isinstance(v, (int, float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", list(registry.SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in df.columns]
    rows = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    other = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert rows == other and rows
