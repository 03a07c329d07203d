import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string, rows string, block string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "s", "r", "p", "b") for i, v, y in rows], SCHEMA)


def brute(rows, every=5, k=5, m=3, low=Fraction(1, 2), high=Fraction(95, 100)):
    sound = {i: ([math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for a, (q, label) in sound.items():
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q, v)), i, y == label) for i, (v, y) in sound.items() if i != a)
        for p, i, _ in [s for s in scores if s[2]][:k]:
            fits = [s for s in scores if not s[2] and low * -p <= -s[0] <= high * -p][:m]
            out |= {(a, i, n + 1, j, -p, -s) for n, (s, j, _) in enumerate(fits)}
    return out


def mined(spark, rows, **how):
    got = hardneg.mine(table(spark, rows), F.col("vec_id") % 5 == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in got.collect()]


@pytest.mark.parametrize(("seed", "block", "chunk", "dim"), [(1, 2048, 512, 16), (2, 32, 8, 70)])
def test_equals_brute_force(spark, seed, block, chunk, dim):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(dim)], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(260)]
    rows += [(i, [0.3] * dim, i % 3) for i in range(260, 380)]  # copies, ties
    rows += [(i, [0.0] * dim, 1) for i in range(380, 384)]
    rows += [(385, None, 1), (390, [None] * dim, 1), (395, [float("nan")] * dim, 1), (400, [0.2] * dim, None), (405, [float("inf")] + [0.0] * (dim - 1), 1), (410, [1.0] * 8, 2), (415, [], 2), (None, [0.1] * dim, 1)]
    got = mined(spark, rows, block=block, chunk=chunk)
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert len(got) > 300


def test_nothing_is_broadcast_and_parts_lose_no_pair(spark, monkeypatch):
    """Copies of a chunk, one a block, grew with the square of the rows and went through the driver: now one a part of
    blocks, merged."""
    plans, write = [], hardneg.written

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(hardneg, "written", noted)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.05, 0.2) for _ in range(16)], rng.choice([0, 0, 0, 1, 2, 3])) for i in range(200)]
    for parts in (1, 3, 1000):
        got = mined(spark, rows, block=16, chunk=8, parts=parts)
        assert len(got) == len(set(got)) and set(got) == brute(rows), parts
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 1)]) == []  # no anchors
    rows = [(0, [1e6, -1e6], 1), (5, [3e6, 1.0], 1), (7, [2.0e6, 2.0], 2), (8, [1.5e6, 2.0], 3), (9, [0.0, 0.0], 3)]
    assert set(mined(spark, rows)) == brute(rows)


def test_scores_of_zero_and_below(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, 2.0], 2), (4, [-0.7, 0.0], 2), (6, [1.0, 1.0], 2)]
    got = mined(spark, rows)
    assert set(got) == brute(rows) == {(0, 1, 1, 3, 0, 0)}


def test_repeated_ids(spark):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2), (2, [0.75], 2)]
    got = sorted(mined(spark, rows, positives=3, negatives=3))
    assert got == sorted((0, 1, n, 2, 65536, 49152) for n in (1, 2) for _ in range(2))


def test_intervals_hold_and_filter():
    rng = np.random.default_rng(3)
    for dim in (3, 64, 100):
        x = rng.normal(0, 60, (900, dim)).astype(np.int64)
        x[:5] = 0
        q = rng.normal(0, 60, (40, dim)).astype(np.int64)
        rotation = hardneg.Rotation(dim)
        low, high = hardneg.intervals(q, hardneg.encoded(x, rotation), rotation)
        true = q @ x.T
        assert (low <= true).all() and (true <= high).all()
        assert (high - low).mean() < 0.25 * np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)).mean()
    assert np.allclose(np.linalg.norm(rotation.turn(q.astype(float)), axis=1), np.linalg.norm(q, axis=1))


def test_clustered_vectors_are_mostly_not_scored(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(20)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[rng.randrange(20)]], i % 2) for i in range(1000)]
    scored = []
    got = mined(spark, rows, scored=scored)
    assert set(got) == brute(rows)
    assert len(scored) == 2 and scored[0][0] < 0.15 * scored[0][1] and scored[1][0] < 0.3 * scored[1][1]


def test_text_labels_and_ids(spark):
    rng = random.Random(5)
    rows = [(f"v{i:03}", [rng.gauss(0.1, 0.2) for _ in range(8)], rng.choice("xy")) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    got = {tuple(r) for r in hardneg.mine(df, F.col("vec_id").endswith("0")).collect()}
    numbered = {(f"v{a:03}", f"v{p:03}", n, f"v{g:03}", s, t) for a, p, n, g, s, t in brute([(int(i[1:]), [float(np.float64(x)) for x in v], y) for i, v, y in rows], every=10)}
    assert {r[:4] for r in got} == {r[:4] for r in numbered}
