"""Registered graph queries against their SQL, and the entry points without the text subpackage."""

from __future__ import annotations

import os

import pytest

from tessera import queries as q

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(D):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{D}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_query(spark, duck, name):
    df = q.queries()[name](spark, D)
    cols = sorted(df.columns)
    found = duck.execute(q.oracle_sql()[name])
    at = [[c[0] for c in found.description].index(c) for c in cols]
    assert sorted(tuple(map(str, r)) for r in df.select(*cols).collect()) == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    assert q.entry(spark, D).count() == 160
