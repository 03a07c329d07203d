import random

from evspark.llm import mixing


def rows(n=3000, seed=2):
    rng = random.Random(seed)
    return [(i, "w " * rng.choice([0, 1, 5, 40, 300]), None, rng.choice(["a", "a", "a", "b", "c", None, "d"])) for i in range(n)]


def targets(sizes, weights=(5, 2, 1), cap=3.0):
    """The contract, step by step: the excess over three times a size is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        left = total - sum(full.values())
        free = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return full | share
        full |= {s: cap * sizes[s] for s in over}


def test_mix(make):
    data = rows()
    got = mixing.mix(make(data)).collect()
    size = {r[0]: len(r[1].split()) for r in data}
    sizes = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 150.5, s  # half of the longest document
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(make(data[::-1]).repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_whole_copies_differ_by_one_at_most(make):
    by = {}
    for r in mixing.mix(make(rows())).collect():
        if r["size"]:
            by.setdefault(r["source"], set()).add(r["copies"])
    assert all(max(v) - min(v) <= 1 for v in by.values())


def test_mixed_rows_repeat_whole_rows(make):
    df = make(rows(400), clash=True)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(df).collect()}
    out = mixing.mixed_rows(df)
    assert out.columns == df.columns
    n = {}
    for r in out.collect():
        n[r["doc_id"]] = n.get(r["doc_id"], 0) + 1
    assert n == {k: v for k, v in copies.items() if v}


def test_nothing_to_mix(make):
    assert mixing.mix(make([])).count() == 0
    assert mixing.mixed_rows(make([])).count() == 0
    assert [(r["taken"], r["target"]) for r in mixing.mix(make([(1, None, None, "a"), (None, "", None, None)])).collect()] == [(0, 0.0), (0, 0.0)]


def test_inclusion_follows_importance(make):
    """Within a source unequal probabilities: rates of inclusion over many seeds follow them, and words stay at the target."""
    from pyspark.sql import functions as F

    data = [(i, "w " * 10, None, "a" if i < 200 else "b") for i in range(400)]
    df = make(data)
    weight = F.when(F.col("doc_id") % 4 == 0, 4.0).when(F.col("doc_id") % 4 == 1, 0.5).when(F.col("doc_id") == 2, None).otherwise(1.0)
    seen, seeds = {}, 12
    for seed in range(seeds):
        total = {}
        for r in mixing.mix(df, weights=(1, 3), seed=seed, importance=weight).collect():
            assert r["copies"] <= 3 and (r["doc_id"] != 2 or r["copies"] == 0)
            seen.setdefault((r["source"], r["doc_id"] % 4), []).append(r["copies"])
            total[r["source"]] = total.get(r["source"], 0) + r["taken"]
        assert abs(total["a"] - 1000) <= 5.5 and abs(total["b"] - 3000) <= 5.5
    rate = {k: sum(v) / len(v) for k, v in seen.items()}
    unit = 1000 / 10 / (50 * 4 + 50 * 0.5 + 99 * 1.0)  # expected copies of importance 1 in source a
    assert abs(rate["a", 0] - 4 * unit) < 0.06 and abs(rate["a", 1] - 0.5 * unit) < 0.06 and abs(rate["a", 3] - unit) < 0.06


def test_importance_and_cap_keep_the_target(make):
    """A source at three times its size takes all documents three times; one near it fills the important ones first."""
    from pyspark.sql import functions as F

    data = [(i, "w " * (10 if i % 2 else 30), None, "a" if i < 40 else "b" if i < 300 else "c") for i in range(900)]
    got = mixing.mix(make(data), weights=(50, 20, 1), importance=F.when(F.col("doc_id") % 2 == 1, 0.25).otherwise(1.0)).collect()
    taken, target, copies = {}, {}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        copies.setdefault((r["source"], r["size"]), []).append(r["copies"])
        assert r["copies"] <= 3
    for s in target:
        assert abs(taken[s] - target[s]) <= 15.5
    assert set(copies["a", 10]) == set(copies["a", 30]) == {3}
    assert sum(copies["c", 30]) / len(copies["c", 30]) > 2 * sum(copies["c", 10]) / len(copies["c", 10])


def test_repeated_ids_and_long_texts(make):
    data = [(1, "w " * 200_000, None, "a"), (1, "w", None, "a"), (1, "w", None, "a"), (None, "w w", None, "b"), (2, "w", None, "b")]
    got = mixing.mix(make(data)).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 1, 2, 200_000]
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
