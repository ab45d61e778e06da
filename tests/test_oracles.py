"""Every moderation query with an oracle, against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from modsieve.plans import moderation as M

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(M.ORACLES))
def test_oracle(spark, duck, name):
    df = M.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(M.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    key = lambda r: repr(r)
    got_rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got_rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)
