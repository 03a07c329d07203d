import hashlib
import re

import pytest

from evspark.llm import dedup


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    out = {}
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            out[i] = (min(ids), len(ids), i == min(ids), sha)
    return out


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (6, "c"), (7, "x" * 300_000), (8, "x" * 300_000), (10, "a b"), (11, "é")]


@pytest.mark.parametrize("bits", [1 << 27, 2])
def test_equal_texts(make, bits):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in dedup.find_copies(make(ROWS), max_bits=bits).collect()}
    assert got == brute(ROWS)


def test_hot_group(make):
    rows = [(i, "same" if i % 3 else f"t{i}") for i in range(6000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in dedup.find_copies(make(rows)).collect()}
    assert got == brute(rows)


def test_drop_keeps_columns_and_smallest_ids(make):
    df = make(ROWS, clash=True)
    out = dedup.drop_copies(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, v in brute(ROWS).items() if v[2])


def test_null_and_repeated_ids(make):
    rows = [(None, "t"), (1, "t"), (1, "t"), (None, "u"), (None, "u"), (2, "v")]
    got = dedup.find_copies(make(rows)).collect()
    assert len(got) == 6
    assert sorted(str(r["keep_id"]) for r in got if r["kept"]) == ["1", "2", "None"]
    assert len(dedup.drop_copies(make(rows)).collect()) == 3


def test_empty_table(make):
    assert dedup.find_copies(make([])).count() == 0
    assert dedup.drop_copies(make([])).count() == 0


def test_clashing_columns_in_find(make):
    got = {r["doc_id"]: r["keep_id"] for r in dedup.find_copies(make(ROWS, clash=True)).collect()}
    assert got == {i: v[0] for i, v in brute(ROWS).items()}


@pytest.mark.parametrize("least", [1, 2])
def test_filter_misses_no_repeat_and_passes_few_others(spark, least):
    from evspark.llm.shared import Repeats

    keys = spark.range(60_000, numPartitions=7).selectExpr("if(id % 10 < 2, id div 20, id) as k")
    got = Repeats.count(keys, "k", 60_000, least=least)
    more = spark.range(200_000).selectExpr("id + 1000000 as k") if least == 1 else keys
    hit = more.select("k", got.test(spark, "k").alias("hit")).groupBy("k").count().where("count > 0")
    tested = {r["k"]: r["hit"] for r in more.select("k", got.test(spark, "k").alias("hit")).distinct().collect()}
    assert hit.count() == len(tested)
    if least == 1:
        assert sum(tested.values()) < 0.02 * len(tested)
        assert all(r["hit"] for r in keys.select(got.test(spark, "k").alias("hit")).distinct().collect())
    else:
        n = {r["k"]: r["count"] for r in keys.groupBy("k").count().collect()}
        assert all(tested[k] for k, c in n.items() if c > 1)
        assert sum(tested[k] for k, c in n.items() if c == 1) < 0.1 * len(n)
