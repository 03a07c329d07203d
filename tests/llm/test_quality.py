import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.llm import quality


def corpus(n=400, seed=8):
    rng = random.Random(seed)
    good = "the old house stood near a quiet river and people walked along".split()
    rows = []
    for i in range(n):
        w = [rng.choice(good) for _ in range(40)]
        rows.append((i, " ".join(f"{x.upper()}!!" for x in w) if i % 8 == 0 else " ".join(w) + "."))
    return rows


def labels(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "doc_id long")


def test_junk_goes_and_clean_stays(spark, make):
    rows = corpus()
    good = labels(spark, [i for i, _ in rows if i % 8 and i % 3] + [1003])
    edge = [(1000, None), (1001, ""), (1002, "river"), (None, "the river."), (1003, "the river. " * 3_000)]
    df = make(rows + edge, clash=True)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df, good).collect()}
    assert all(got[i] == (i % 8 != 0) for i, _ in rows)
    assert all(got[i] for i in (1000, 1001, 1002, None, 1003))
    out = quality.keep_good(df, good)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, k in got.items() if k)


def test_weights_equal_plain_python(spark, make):
    rows = corpus(60)
    good = [i for i, _ in rows if i % 8]
    model = quality.train(make(rows), labels(spark, good), buckets=2048)
    of = quality.Buckets(256)  # folded, the sample being small
    raw, target = np.zeros(256), np.zeros(256)
    for i, t in rows:
        for ids in of(t):
            np.add.at(raw, ids, 1)
            if i in good:
                np.add.at(target, ids, 1)
    r = (raw + 0.5) / (raw.sum() + 128)
    lean = (0.05 * target.sum() + 1000) / 256
    want = np.log((target + lean * r * 256) / (target.sum() + lean * 256) / r)
    assert np.allclose(model.log_ratio, want)
    got = {x["doc_id"]: x["log_weight"] for x in make(rows).select("doc_id", quality.log_weight(make(rows), model).alias("log_weight")).collect()}
    n = lambda t: sum(len(ids) for ids in of(t))
    assert all(math.isclose(got[i], sum(want[ids].sum() for ids in of(t)) * min(1, quality.SPAN / n(t)), rel_tol=1e-9, abs_tol=1e-9) for i, t in rows)


def test_long_texts_are_cut_without_losing_pairs():
    of = quality.Buckets(64)
    text = " ".join(f"w{i % 7}" for i in range(450_000))
    assert sum(len(x) for x in of(text)) == 2 * 450_000 - 1


@pytest.mark.parametrize("k", [1, 2, 7, 500, 999, 1000])
def test_kth_largest(spark, k):
    rng = random.Random(k)
    v = [rng.choice([rng.gauss(0, 100), 5.0, -1e6]) for _ in range(1000)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    assert quality.kth_largest(df, "x", k, bins=8) == sorted(v, reverse=True)[k - 1]


def test_gumbel_draws_in_proportion(spark):
    df = spark.range(40_000).withColumn("g", quality.gumbel(F.col("id"), 1))
    mean, dev = df.agg(F.avg("g"), F.stddev("g")).first()
    assert abs(mean - 0.5772) < 0.03 and abs(dev - 1.2825) < 0.03


def test_nothing_labelled_keeps_all_and_empty_stays_empty(spark, make):
    assert all(r["kept"] for r in quality.judge(make(corpus(20)), labels(spark, [])).collect())
    assert quality.judge(make([]), labels(spark, [1])).count() == 0


def test_kept_equals_gumbel_top_k(spark, make):
    """Noise from the id, k by the floor, ties and repeated rows stay together: recomputed in plain Python."""
    import hashlib

    rows = corpus(200) + [(500, "ZZZ!! " * 40)] * 3 + [(None, "ZZZ!! " * 40), (None, "river")]
    got = quality.judge(make(rows), labels(spark, [i for i, _ in rows[:200] if i % 8])).collect()
    assert len(got) == len(rows)

    def noise(i):
        u = (int(hashlib.md5(f"{'' if i is None else i}:5".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(-math.log(u))

    k = sum(r["log_weight"] >= quality.FLOOR for r in got)
    cut = sorted((r["log_weight"] + noise(r["doc_id"]) for r in got), reverse=True)[k - 1]
    assert 0 < k < len(rows)
    for r in got:
        assert math.isclose(r["noisy"], r["log_weight"] + noise(r["doc_id"]), rel_tol=1e-9, abs_tol=1e-9)
        assert r["kept"] == (r["noisy"] >= cut - 1e-9)
    assert len({r["kept"] for r in got if r["doc_id"] == 500}) == 1
