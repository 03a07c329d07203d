"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import collections
import math
import os

import duckdb
import pytest

from evspark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if getattr(v, "tzinfo", None) is not None:
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = collections.Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
