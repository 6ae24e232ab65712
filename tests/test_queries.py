"""Registered queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__
from stratagram.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{sf}/{name}')")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, db, name):
    rows = QUERIES[name](spark, sf).toPandas()
    assert len(rows)
    if name in ORACLES:
        want = db.execute(ORACLES[name]).df()
        columns = sorted(rows.columns)
        assert columns == sorted(want.columns)
        order = lambda f: sorted(map(tuple, f[columns].astype(object).values.tolist()), key=str)
        for a, b in zip(order(rows), order(want), strict=True):
            assert all(x == y or isinstance(x, float) and x == pytest.approx(y, rel=1e-5, abs=1e-3) for x, y in zip(a, b))


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[-1] == "residual"
