"""Cosine search, mergeable distinct counts, deep pages."""

import random

import pytest
from pyspark.sql import functions as F

from evspark.operators import bitmaps, cosine, paging


def brute(vecs, queries, k, least):
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(y * y for y in b) ** 0.5)
    out = set()
    for q, a in queries:
        s = sorted((-cos(b, a), i) for i, b in vecs if i != q)
        out |= {(q, n + 1, i) for n, (c, i) in enumerate([x for x in s if -x[0] > least][:k])}
    return out


@pytest.mark.parametrize(("dim", "block", "chunk"), [(5, 1000, 1000), (40, 16, 7), (100, 64, 16)])
def test_cosine_equals_brute_force(spark, dim, block, chunk):
    rng = random.Random(dim)
    vecs = [(i, [rng.gauss(0.1, 1) for _ in range(dim)]) for i in range(150)] + [(i, [0.5] * dim) for i in range(150, 170)]
    odd = [(200, None), (201, [None] * dim), (202, [0.0] * dim), (203, [float("nan")] * dim), (204, [1.0] * (dim - 1)), (None, [1.0] * dim)]
    df = spark.createDataFrame([(i, v, "x") for i, v in vecs + odd], "id long, v array<double>, block string")
    queries = df.filter("id % 3 = 0")
    full = []
    got = cosine.best(df, queries, "id", "v", 4, 0.0, block, chunk, full)
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == brute(vecs, [v for v in vecs if v[0] % 3 == 0], 4, 0.0)
    assert full[0][1] == 170 * 57
    assert cosine.best(df.filter("false"), queries, "id", "v", 4, 0.0).count() == 0
    assert cosine.best(df, queries.filter("false"), "id", "v", 4, 0.0).count() == 0


def test_few_products_are_taken_in_full(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(12)]
    vecs = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 12]]) for i in range(600)]
    df = spark.createDataFrame(vecs, "id long, v array<double>")
    full = []
    got = cosine.best(df, df.filter("id % 20 = 0"), "id", "v", 3, 0.4, full=full)
    assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == brute(vecs, vecs[::20], 3, 0.4)
    assert full[0][0] < 0.2 * full[0][1]


def test_distinct_counts_from_parts(spark):
    rng = random.Random(2)
    rows = [(f"u{rng.randint(0, 60_000)}" if rng.random() > 0.1 else None, rng.choice("abc"), rng.randint(0, 9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "u string, source string, day int")
    numbers = bitmaps.numbered(df, "u")
    n = len({r[0] for r in rows if r[0]})
    assert sorted(r["identity_no"] for r in numbers.collect()) == list(range(n))
    kept = bitmaps.parts(df.join(numbers, "u", "left"), ["source", "day"])
    for days in (range(10), (3,), (2, 5, 7)):
        got = {r["source"]: (r["n"], r["n_identities"]) for r in bitmaps.merged(kept.filter(F.col("day").isin(list(days))), ["source"]).collect()}
        assert got == {s: (sum(r[1] == s and r[2] in days for r in rows), len({r[0] for r in rows if r[1] == s and r[2] in days and r[0]})) for s in "abc"}


def test_pages(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 20), None if i % 50 == 0 else "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, g int, s string")
    pages = paging.Pages.store(df, [F.col("g").desc(), "id"], f"{tmp_path}/p", ranges=9)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert pages.total == 1000 and len(pages.counts) > 5
    for number in (1, 2, 17, 31, 32, 40):
        assert [r["id"] for r in pages.page(number, 32).collect()] == [r[0] for r in want[(number - 1) * 32 : number * 32]]
    plan = pages.page(32, 32)._jdf.queryExecution().executedPlan().toString()
    assert "__range#" in plan.split("PartitionFilters: ")[1].split("]")[0]  # one range's files are read
    assert paging.Pages.store(df.filter("false"), ["id"], f"{tmp_path}/e").page(1, 5).count() == 0
