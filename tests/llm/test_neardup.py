import random
from fractions import Fraction

import numpy as np
import pytest

from evspark.llm import neardup


def words_of(text):
    return [w for w in (text or "").encode().lower().split()]


def brute(rows, k, least):
    """All pairs by full sets; components by flooding."""
    sets = {}
    for i, text in rows:
        w = words_of(text)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    near = {i: [] for i in ids}
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both * least.denominator >= least.numerator * len(sets[i] | sets[j]):
                near[i].append(j)
                near[j].append(i)
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                v = todo.pop()
                if v not in root:
                    root[v] = i
                    todo += near[v]
    return {i: (len(sets[i]), root[i]) for i in ids}


def mutated(rng, base, k):
    w = list(base)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"m{rng.randrange(10**6)}"
    return w


def corpus(seed, n=12, copies=10):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 80, 200]))]
        for _ in range(copies):
            rows.append(" ".join(mutated(rng, base, rng.choice([0, 1, 2, 3, 5]))))
    rows += ["", None, " \t", "One", "one", "a b", "A  B", "x y z", "x" * 100_000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "k", "least", "block"), [(1, 3, Fraction(85, 100), 512), (2, 5, Fraction(4, 5), 512), (3, 3, Fraction(85, 100), 7)])
def test_components_equal_brute_force(make, seed, k, least, block):
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_classes(make(rows), k, least, block=block).collect()}
    assert got == brute(rows, k, least)


def test_chain_of_links_through_one_hub(make):
    """Copies that link to the base only, not to each other."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(mutated(rng, base, 3))) for i in range(40)] + [(40, " ".join(base))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_classes(make(rows), 3, Fraction(85, 100), block=8).collect()}
    assert got == brute(rows, 3, Fraction(85, 100))


def test_nulls_repeats_and_drop(make):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (1, text), (1, text), (2, text + " tail"), (3, None), (4, ""), (5, "other words stand here now")]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_classes(make(rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True)], key=str)
    df = make(rows, clash=True)
    out = neardup.drop_near(df)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "1", "3", "4", "5", "None"]


def test_empty_table(make):
    assert neardup.near_classes(make([])).count() == 0
    assert neardup.drop_near(make([])).count() == 0


def test_bins_estimate_similarity():
    """Densified bins agree about as often as the sets are similar, small sets too."""
    rng = np.random.default_rng(1)
    for n in (10, 60, 2000):
        agree = []
        for _ in range(60):
            h = neardup.mix64(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
            one, two = np.unique(h[: 3 * n // 2]), np.unique(h[n // 2 :])  # similarity 1/2
            p = neardup.OnePermutation(160, 1)
            agree.append((p(one) == p(two)).mean())
        assert abs(np.mean(agree) - 0.5) < 0.06, n


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["label"] for r in neardup.components(links).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_large_group_of_near_copies_in_buckets_of_their_own(make):
    """More blocks than bands: the neighbourhood is taken apart by bucket."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(mutated(rng, base, rng.choice([1, 3, 6])))) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_classes(make(rows), 3, Fraction(85, 100), block=1).collect()}
    assert got == brute(rows, 3, Fraction(85, 100))


def test_fewer_links_keep_components(spark):
    rng = random.Random(8)
    stars = [(a, b) for b in range(10, 400) for a in {rng.randrange(b // 10 * 10) for _ in range(3)} if rng.random() < 0.3]
    links = spark.createDataFrame(stars, "a long, b long")
    few = neardup.fewer_links(links)
    root = {}
    for x in sorted({v for e in stars for v in e}):
        if x not in root:
            todo = [x]
            while todo:
                v = todo.pop()
                if v not in root:
                    root[v] = x
                    todo += [b if a == v else a for a, b in stars if v in (a, b)]
    assert {r["node"]: r["label"] for r in neardup.components(few).collect()} == root
