import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from evspark.llm import lm


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    kinds = ["the cat sat on the mat and the dog ran".split(), "der hund lief und die katze sass auf der matte".split()]
    return [(i, " ".join(rng.choice(k) for _ in range(30)) + f" n{rng.randrange(60)}") for i in range(n) for k in [rng.choice(kinds)]]


def tokens(text):
    return (text or "").encode().lower().split() + [b" "]


def test_counts_and_base(make):
    rows = corpus()
    train = [r for r in rows if r[0] % 10]
    edge = [(1000, None), (1001, ""), (1002, "Unknown words ÉÉ the"), (1003, "the " * 120_000), (None, "cat"), (1000, None)]
    model, counts = lm.train(make(train), max_head=8)
    got = lm.score(make(rows + edge, clash=True), model, counts, keep=[F.col("doc_id"), F.col("text")]).collect()
    c = Counter(t for _, x in train for t in tokens(x))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows) + len(edge)
    for r in got:
        t = tokens(r["text"])
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in c for w in t), n)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base)) and math.isfinite(r["score"]) and r["score"] < 0


def test_model_beats_the_base_on_held_out(make):
    rows = corpus(600)
    model, counts = lm.train(make([r for r in rows if r[0] % 10]))
    held = lm.score(make([r for r in rows if r[0] % 10 == 0]), model, counts).agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] + 10


def test_probabilities_sum_to_one(make):
    """Over the vocabulary and one unknown token of each leaf."""
    model, counts = lm.train(make(corpus(60)))
    share = 0.1 / model.leaf_mass
    for r in counts.collect():
        leaf = model.leaf_of(bytes(r["token"]))
        share[leaf] += (r["n"] + 0.1) / model.leaf_mass[leaf]
    used = [k * 256 for k in range(lm.SINGLE)] + list(range(lm.SINGLE * 256, lm.LEAVES))
    assert np.allclose(share[used], 1)
    leaf, h = np.array([3, 8, 9], np.int32) * 256 + 37, np.array([5, 6, 7], np.uint32)
    rows = lm.features(leaf // 256, h)
    every = [np.exp(lm.log_prob(model.class_w, rows, np.full(3, k))) for k in range(lm.CLASSES)]
    assert np.allclose(sum(every), 1, atol=1e-5)
    bits = len(model.leaf_w).bit_length() - 1
    nodes = (leaf // 256, leaf // 16)
    for w, x, bias, node in zip((model.branch_w, model.leaf_w), lm.inner_rows(leaf, h, bits), model.biases(), nodes, strict=True):
        every = [np.exp(lm.log_prob(w, x[None], np.full(3, k), bias[node])) for k in range(16)]
        assert np.allclose(sum(every), 1, atol=1e-5)


def test_context_within_classes(make):
    """Two words of one class and branch follow two others strictly: only the leaf factor can tell."""
    from zlib import crc32

    words = [a + b + "zzz" for a in "abcdefghij" for b in "klmnopqrst"]
    x, y = next((a, b) for a in words for b in words if crc32(a.encode()) >> 20 & 15 != crc32(b.encode()) >> 20 & 15)
    common = " ".join(f"f{i % 7} " * 3 for i in range(7))
    rng = random.Random(1)
    texts = [common + " ".join(rng.choice((f"left {x}", f"right {y}")) for _ in range(20)) for _ in range(300)]
    model, counts = lm.train(make(list(enumerate(texts))), rounds=4)
    right, wrong = (lm.score(make([(1, common + t)]), model, counts).first() for t in (f"left {x} right {y}", f"left {y} right {x}"))
    assert abs(right["base_score"] - wrong["base_score"]) < 1e-9 and right["score"] > wrong["score"] + 0.3


def test_nothing_to_learn_from(make):
    model, counts = lm.train(make([]))
    r = lm.score(make([(1, "a b")]), model, counts).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0) and math.isfinite(r["score"])
    assert lm.score(make([]), model, counts).count() == 0


def test_score_equals_brute_force(make):
    """Token by token: softmax over classes, branches and leaves from the rows of weights, times the token's smoothed share of its leaf."""
    from zlib import crc32

    train = [r for r in corpus(200) if r[0] % 10]
    model, counts = lm.train(make(train), max_head=8)
    assert all(np.abs(w).sum() > 0 for w in (model.class_w, model.branch_w, model.leaf_w))
    c = {bytes(r["token"]): r["n"] for r in counts.collect()}
    leaf_n, leaf_v = Counter(), Counter()
    for w, k in c.items():
        leaf_n[int(model.leaf_of(w))] += k
        leaf_v[int(model.leaf_of(w))] += 1
    mass = lambda first, width: sum(leaf_n[x] + 0.1 * (leaf_v[x] + 1) for x in range(first, first + width))
    docs = [(1, "the cat ran unknown der"), (2, None), (3, "katze " * 40 + "zzz"), (1, "the cat ran unknown der"), (None, "mat")]
    got = lm.score(make(docs, clash=True), model, counts, keep=[F.col("text")]).collect()
    assert len(got) == len(docs)
    for r in got:
        t, total = tokens(r["text"]), 0.0
        leaf = [int(model.leaf_of(w)) for w in t]
        cls = [0, 0] + [x // 256 for x in leaf]
        h = [0, 0, 0] + [crc32(w) for w in t]
        for i, w in enumerate(t):
            at = [cls[i + 1] * lm.CLASSES + cls[i]]
            for k in range(3):
                at.append(((h[i + 2 - k] * int(lm.FACTORS[k])) % 2**32 >> 20) + lm.CLASSES**2 + k * lm.HASHED)
            z = sum(model.class_w[a].astype(float) for a in at)
            k = cls[i + 2]
            total += (z[k] - math.log(np.exp(z).sum())) / math.log(10) + math.log10((c.get(w, 0) + 0.1) / mass(leaf[i], 1))
            if k < lm.SINGLE:
                continue
            node, before = leaf[i] // 16, leaf[i - 1] // 16 if i else 0
            hashed = ((h[i + 2] * int(lm.FACTORS[0]) ^ node * int(lm.FACTORS[1])) % 2**32 * int(lm.FACTORS[2])) % 2**32 >> 33 - len(model.leaf_w).bit_length()
            for weights, own, first, width in ((model.branch_w[before * lm.CLASSES + k], node % 16, k * 256, 16), (model.leaf_w[hashed], leaf[i] % 16, node * 16, 1)):
                share = np.array([mass(first + j * width, width) for j in range(16)])
                z = weights.astype(float) + np.log(share / share.sum())
                total += (z[own] - math.log(np.exp(z).sum())) / math.log(10)
        assert abs(r["score"] - total) < 1e-4 * max(1, abs(total))


def test_hot_token_outside_the_head(spark, make, monkeypatch):
    """A word that only held-out rows have, in most rows: joined to its (absent) count without meeting in one task."""
    from evspark.llm import shared

    monkeypatch.setattr(shared, "HOT_ROWS", 5)
    docs = make([(i, f"a b w{i} rare" if i % 2 else f"hot a w{i}") for i in range(60)])
    model, counts = lm.train(docs.filter("doc_id % 2 = 1"), max_head=2)
    got = {r["doc_id"]: r for r in lm.score(docs, model, counts, keep=[docs["doc_id"]]).collect()}
    assert len(got) == 60
    assert all(got[i]["n_known"] == (5 if i % 2 else 2) for i in got)


def test_texts_read_at_once_are_apart():
    """Weight rows of texts one after the other are those of each text alone, texts of one token included."""
    rng = np.random.default_rng(2)
    sizes = [1, 1, 2, 5, 1, 3, 1]
    starts, n = np.cumsum([0, *sizes[:-1]]), sum(sizes)
    leaf, h = rng.integers(0, lm.LEAVES, n).astype(np.int32), rng.integers(0, 2**32, n).astype(np.uint32)
    parts = [slice(s, s + k) for s, k in zip(starts, sizes, strict=True)]
    assert (lm.features(leaf // 256, h, starts) == np.concatenate([lm.features(leaf[p] // 256, h[p]) for p in parts], axis=1)).all()
    for got, want in zip(lm.inner_rows(leaf, h, 14, starts), zip(*(lm.inner_rows(leaf[p], h[p], 14) for p in parts), strict=True), strict=True):
        assert (got == np.concatenate(want)).all()


def test_words_are_cut_and_hashed_as_bytes():
    """Split, lower-cased and hashed column by column as bytes.split, bytes.lower and crc32 do it, empty and null texts included."""
    from zlib import crc32

    import pyarrow as pa

    texts = ["", None, "  A b\t\tC\x0b\x0c\r\n", "É\x1cÀ x\x85y z", "a" * 65 + " " + "B" * 64 + " zz", " ", "the a THE"]
    texts = [*texts, "cut off"]
    column = pa.array(["cut off", *texts])[1:-1]
    words = [tokens(t) for t in texts[:-1]]
    flat, n = lm.split(column)
    assert flat.to_pylist() == [x for w in words for x in w[:-1]] and n.tolist() == [len(w) - 1 for w in words]
    assert all(lm.word_crcs(flat, k).tolist() == [crc32(x if k is None else x[-k:]) for x in flat.to_pylist()] for k in (None, 2, 3))
    single, head = {b" ": 0, b"a": 1}, {b" ": 9, b"the": 3, b"a": 4}
    model = lm.Model(9, 9, single, head, np.full(lm.LEAVES, 0.1), *(np.zeros((2, 2), np.float32),) * 3)
    lm.Reader.PART, whole = 2, lm.Reader.PART  # a batch of several parts
    try:
        leaf, h, log_c, starts, at = lm.Reader(model).tokens(column)
    finally:
        lm.Reader.PART = whole
    every = [x for w in words for x in w]
    assert leaf.tolist() == [model.leaf_of(x) for x in every] and h.tolist() == [crc32(x) for x in every]
    assert at(np.arange(len(every))) == every and starts.tolist() == np.cumsum([0, *map(len, words)])[:-1].tolist()
    assert np.allclose(log_c, [math.log10(head.get(x, math.nan) + 0.1) for x in every], equal_nan=True)


def test_step_of_shared_nodes_is_that_of_single_tokens():
    """Tokens of one row and node are taken together; rows, own branches and nodes collide in every way."""
    rng = np.random.default_rng(4)
    rows, own, nodes = rng.integers(3, 9, 200), rng.integers(0, 16, 200), rng.integers(0, 4, 200)
    w, biases = rng.normal(size=(12, 16)).astype(np.float32), rng.normal(size=(4, 16)).astype(np.float32)
    got = lm.Adagrad(w, 0.3)
    got.step_nodes(rows.astype(np.uint32), own, nodes, biases)
    z = w[rows].astype(float) + biases[nodes]
    z = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) - np.eye(16)[own]
    for r in range(12):
        mean = z[rows == r].mean(axis=0) if (rows == r).any() else np.zeros(16)
        assert np.allclose(got.w[r], w[r] - 0.3 * mean / np.sqrt(0.01 + mean**2), atol=1e-4) and got.use[r] == (rows == r).sum()
    classes, features = rng.integers(0, 16, 200), np.stack([rng.integers(0, 5, 200), rng.integers(7, 12, 200)]).astype(np.uint16)
    got = lm.Adagrad(w, 0.3)
    got.step(features, classes)
    z = w[features[0]].astype(float) + w[features[1]]
    z = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True) - np.eye(16)[classes]
    for r in range(12):
        mine = (features == r).any(axis=0)
        mean = z[mine].mean(axis=0) if mine.any() else np.zeros(16)
        assert np.allclose(got.w[r], w[r] - 0.3 * mean / np.sqrt(0.01 + mean**2), atol=1e-4) and got.use[r] == mine.sum()
