import os
from collections import Counter

import pytest

import corpus_pipeline
from evspark.llm.shared import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again."""
    base, docs = tmp_path_factory.mktemp("stages"), table(spark, DATA, "documents")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], DATA).write.parquet(f"{base}/{k}")
        out.append(spark.read.parquet(f"{base}/{k}"))
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_keeps_labelled_good_rows(spark, stages):
    kept = {r["doc_id"] for r in stages[1].collect()}
    bad = [r["doc_id"] in kept for r in table(spark, DATA, "labels").collect() if r["quality"] == 0]
    good = [r["doc_id"] in kept for r in table(spark, DATA, "labels").collect() if r["quality"] == 1]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_exact_dedup_is_brute_force(stages):
    import re

    first = {}
    for r in sorted(stages[1].collect(), key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert sorted(first.values()) == sorted(r["doc_id"] for r in stages[2].collect())


def test_near_dedup_is_brute_force(stages):
    from fractions import Fraction

    from tests.llm.test_neardup import brute

    want = {i for i, (_, root) in brute([(r["doc_id"], r["text"]) for r in stages[2].collect()], 5, Fraction(4, 5)).items() if i == root}
    assert want == {r["doc_id"] for r in stages[3].collect()}


def test_mix_and_encoding(stages):
    mixed = Counter(r["doc_id"] for r in stages[4].collect())
    assert max(mixed.values()) <= 3 and set(mixed) <= {r["doc_id"] for r in stages[3].collect()}
    coded = stages[5].collect()
    assert Counter(r["doc_id"] for r in coded) == mixed
    import hashlib

    text = {r["doc_id"]: r["text"] or "" for r in stages[4].collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() and len(r["token_ids"]) == 4 * r["n_tokens"] for r in coded)


def test_run_gives_the_same_rows(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, stages[-1].select("doc_id", "ids_sha256").collect()))


def test_stages_take_nulls_long_texts_repeats_and_clashing_columns(spark, make):
    good = [" ".join(f"word{(i * 7 + j) % 90}" for j in range(60)) + "." for i in range(40)]
    rows = [(i, t, "en", "ab"[i % 2]) for i, t in enumerate(good)] + [(50, good[0], "en", None), (51, None, None, None), (52, None, None, "a"), (53, "", None, "b"), (None, good[1], "en", "a"), (None, None, None, None)]
    rows += [(60, "long text " * 60_000, "en", "a"), (61, good[2], "en", "a"), (61, good[2], "en", "a")]
    docs = make(rows, clash=True)
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, DATA)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            out = corpus_pipeline.written(out)
            assert 0 < out.count() <= 3 * docs.count(), name
        docs = out
    got = docs.collect()
    assert all(r["decoded_sha256"] and len(r["token_ids"]) == 4 * r["n_tokens"] for r in got)


def test_stages_take_an_empty_table(spark, make):
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, make([], clash=True), DATA).count() == 0, name
