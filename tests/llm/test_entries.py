"""The queries that SQL can express give DuckDB's rows, and the others one row a document."""

import collections
import os

import pytest

from evspark.llm import entries

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = entries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cur = con.execute(entries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == collections.Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


@pytest.mark.parametrize("name", ["op3_byte_bpe", "op8_secret_scan", "op10_interleaved_shards", "op11_word_bpe", "op12_periodic_runs"])
def test_one_row_a_document(spark, name):
    want = sorted(r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())
    assert sorted(r["doc_id"] for r in entries.QUERIES[name](spark, DATA).select("doc_id").collect()) == want
