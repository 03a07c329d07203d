import math
import random

import pytest
from pyspark.sql import functions as F

from evspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "s", "r", "p") for i, v in rows], SCHEMA)


def brute(rows, k=5, every=5):
    import numpy as np

    sound = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in sound.items():
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound.items() if i != q)
            out |= {(q, n + 1, i, -p) for n, (p, i) in enumerate(s[:k])}
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 16)])
def test_equals_brute_force(spark, seed, block):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(300)]
    hot = [0.5] * 16
    rows += [(i, hot) for i in range(300, 420)]  # ties
    rows += [(420, None), (421, [None] * 16), (425, [float("nan")] * 16), (430, [float("inf")] + [0.0] * 15), (435, [1.0] * 8), (440, [])]
    got = {tuple(r) for r in topk.best(table(spark, rows), F.col("vec_id") % 5 == 0, 5, block=block).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows)


def test_few_rows_and_large_values(spark):
    rows = [(0, [1e6, -1e6]), (5, [3e6, 1.0]), (7, [2.0, 2.0])]
    got = {tuple(r) for r in topk.best(table(spark, rows), F.col("vec_id") % 5 == 0, 5).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows)
    assert topk.best(table(spark, []), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.best(table(spark, [(0, [1.0])]), F.col("vec_id") % 5 == 0).count() == 0


def test_search_stops_early_where_vectors_cluster(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 4) for _ in range(8)] for _ in range(16)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 16]]) for i in range(800)]
    looked = []
    got = {tuple(r) for r in topk.best(table(spark, rows), F.col("vec_id") % 5 == 0, 5, looked_at=looked).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows)
    rings = 16 * 8 * 160
    assert sum(n for n, _ in looked) < 0.5 * rings


def test_null_and_repeated_ids(spark):
    rows = [(None, [9.0]), (0, [1.0]), (0, [1.0]), (1, [3.0]), (2, [2.0]), (2, [2.0])]
    got = sorted(tuple(r) for r in topk.best(table(spark, rows), F.col("vec_id") % 5 == 0, 3).select("query_id", "rank", "vec_id").collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 2)]
