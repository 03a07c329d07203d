import hashlib
import random

import numpy as np
import pytest

from evspark.llm import entries, periodic


def brute(words, least=6, power=4):
    """All runs by their definition: for each period the maximal stretches in which words that far apart are equal."""
    n, out = len(words), {}
    for p in range(1, n // power + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, power * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def numbered(words):
    codes = {}
    return np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)


def texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            base = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            words += base * rng.randint(1, 8) + base[: rng.randint(0, len(base))]
        yield words


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    docs = [*texts(seed, 150), [], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 500, ["a", "b"] * 300, [str(i) for i in range(400)]]
    rows = periodic.runs_of([numbered(d) for d in docs])
    for k, d in enumerate(docs):
        assert [tuple(r[1:]) for r in rows[rows[:, 0] == k].tolist()] == brute(d), d


def test_extensions_equal_plain_comparison():
    rng = random.Random(1)
    seq = [0, *[rng.choice([1, 1, 1, 2, 3]) for _ in range(3000)], *[1, 2] * 400, *[3] * 500, 4]
    g = periodic.Grammar(np.array(seq, np.int64))
    a = np.array([rng.randint(1, len(seq) - 3) for _ in range(2000)])
    b = np.array([rng.randint(x + 1, len(seq) - 2) for x in a])
    for way, step in ((g.right, 1), (g.left, -1)):
        for x, y, got in zip(a.tolist(), b.tolist(), g.extend(a, b, way).tolist(), strict=True):
            n = 0
            while 0 <= x + step * n and y + step * n < len(seq) and seq[x + step * n] == seq[y + step * n]:
                n += 1
            assert got == n


def test_grammar_is_small_and_flat():
    rng = random.Random(2)
    seq = np.array([0, *[rng.randint(2, 50) for _ in range(20_000)], 1], np.int64)
    assert len(periodic.Grammar(seq).sym) < 12 * len(seq)
    assert len(periodic.Grammar(np.array([0, *[2] * 20_000, 1], np.int64)).sym) < 20_010


def test_long_text_of_one_period():
    words = [f"w{i}" for i in range(5000)] * 5
    assert periodic.runs_of([numbered(words)]).tolist() == [[0, 0, 25_000, 5000]]
    assert periodic.runs_of([numbered(["x"] * 300_000)]).tolist() == [[0, 0, 300_000, 1]]


def check(r, words, runs):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = [w for i, w in enumerate(words) if i not in dropped]
    assert r["n_runs"] == len(runs)
    assert r["runs_sha256"] == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode())
    assert r["collapsed_sha256"] == sha(" ".join(kept).encode())
    if runs:
        from fractions import Fraction

        s, n, p = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == (s, n, p, 1000 * n // p)
    else:
        assert r["start"] is r["length"] is r["period"] is r["exponent_milli"] is None


def test_find_runs(spark, make, monkeypatch):
    monkeypatch.setattr(periodic, "GROUP_WORDS", 50)
    rows = [(i, " \t".join(w)) for i, w in enumerate(texts(9, 60))]
    rows += [(100, None), (101, ""), (102, "é é é é é é"), (102, "é é é é é é"), (None, "x y " * 1000), (103, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb")]
    got = periodic.find_runs(make(rows, clash=True), with_runs=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        runs = brute(words)
        for r in by[i]:
            check(r, words, runs)
            assert [tuple(x) for x in r["runs"]] == runs
            assert hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"]
    assert periodic.find_runs(make([])).count() == 0
    with pytest.raises(ValueError, match="grid"):
        periodic.find_runs(make([]), power=2)


def test_query_equals_brute_force(spark, tmp_path, make):
    """The registered query, its planted periods included, on a small table of its own."""
    from zlib import crc32

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "dd"]) for _ in range(rng.randint(0, 120)))) for i in range(200)] + [(None, "a b c d e f g h"), (7000, None)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = entries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    planted = 0
    for r in got:
        words = (text[r["doc_id"]] or "").split()
        h = crc32(str(r["doc_id"]).encode())
        if r["doc_id"] is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        check(r, words, brute(words))
    assert planted > 10
