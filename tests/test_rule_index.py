import random

import pytest
from pyspark.sql import functions as F

from evspark.operators import gram_index, rules
from evspark.operators.rule_index import RuleIndex

WORDS = ["click", "lick", "clic", "purchase", "İstanbul", "straße", "abc", "ab", "", "10", "9.5", "nan", "a.b", "x|y"]


def random_rules(rng, n, most=4, fields=("a", "b"), operators=("contains", "equals", "in", ">", "<=", "<", ">=", "regex", "not_equals", "wildcard")):
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(1, most)):
            op = rng.choice(operators)
            value = rng.choice(WORDS) if op in ("contains", "equals", "not_equals") else rng.choice(["click, abc", "10,ab"]) if op == "in" else rng.choice(["lick|urch", "^cl", "a.b", "abc"]) if op == "regex" else rng.choice([1, 9.5, 10])
            parts.append({"field": rng.choice(fields), "operator": op, "value": value, "source": rng.choice([None, None, "S1"])})
        out.append({"rule_id": f"r{i:04}", "label": "x", "logic": rng.choice(["AND", "OR"]), "min_indicators": rng.choice([1, 1, 2]), "conditions": parts})
    return rules.rules_of(out)


def table(spark, rng, n=60):
    cell = lambda: rng.choice([None, "".join(rng.choice(WORDS) for _ in range(rng.randint(1, 3))), rng.choice(WORDS).upper()])
    return spark.createDataFrame([(i if i % 13 else None, cell(), cell(), "other") for i in range(n)], "id long, a string, b string, gram string")


@pytest.mark.parametrize("seed", range(3))
def test_prefilter_loses_nothing(spark, seed):
    rng = random.Random(seed)
    df = table(spark, rng, 120).cache()
    index = gram_index.GramIndex.build(df, "id", ["a", "b"])
    narrowed = 0
    for _ in range(12):
        some = random_rules(rng, rng.randint(1, 2), most=2, operators=("contains", "equals", "in", "regex", ">"))
        alone = rules.tag_rows(df, some).filter(F.size("rule_ids") > 0)
        after = index.prefilter(df, some)
        narrowed += after.count() < df.count()
        assert sorted(map(str, rules.tag_rows(after, some).filter(F.size("rule_ids") > 0).collect())) == sorted(map(str, alone.collect())), some
    assert narrowed


def test_prefilter_of_the_known_losses(spark):
    df = spark.createDataFrame([(1, "click", "view", 5.0), (2, "x", "purchase", 1.0), (3, "x", "view", 95.0)], "id long, text string, source string, value double")
    index = gram_index.GramIndex.build(df, "id", ["text", "source"])
    ids = lambda r, **k: sorted(x["id"] for x in index.prefilter(df, rules.rules_of(r), **k).collect())
    assert ids([{"rule_id": "a", "label": "A", "conditions": [{"field": "text", "operator": "contains", "value": "lick"}]}]) == [1]
    either = {"rule_id": "b", "label": "B", "logic": "OR", "conditions": [{"field": "source", "value": "purchase"}, {"field": "value", "operator": ">", "value": 90}]}
    assert ids([either]) == [1, 2, 3]
    both = {**either, "logic": "AND"}
    assert ids([both]) == [2]
    none = {"rule_id": "c", "label": "C", "conditions": [{"field": "text", "operator": "contains", "value": "nowhere"}]}
    assert ids([none]) == [] and ids([none], fall_back=True) == [1, 2, 3]


def test_gram_scan_reads_few_files(spark):
    df = spark.range(2000).select(F.col("id"), F.concat(F.lit("word"), F.col("id").cast("string")).alias("text"))
    index = gram_index.GramIndex.build(df, "id", ["text"])
    r = rules.rules_of([{"rule_id": "a", "label": "A", "conditions": [{"field": "text", "operator": "contains", "value": "d1999"}]}])
    plan = index.candidates(r)._jdf.queryExecution().executedPlan().toString()
    assert "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert [x["key"] for x in index.candidates(r).collect()] == [1999]


def test_postings_are_made_by_block(spark, monkeypatch):
    """A row a gram and block instead of one a gram and key; texts of every plane, repeated keys, empty and null texts."""
    texts = ["ababab word", "x\n𝔸𝔹c", "İSTANBUL ΣΑΣ", "ab", "", None, "\U0010ffffab"] * 40
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1)
    index = gram_index.GramIndex.build(df, "id", ["text"])
    got = {(r["gram"], k) for r in index.postings().collect() for k in r["keys"]}
    lower = df.selectExpr("id", "lower(text) as t").collect()
    assert got == {(g, r["id"]) for r in lower if r["t"] for g in gram_index.grams_of(r["t"])}
    assert index.postings().count() == len({g for g, _ in got})
    monkeypatch.setattr(gram_index, "BLOCK", 50)
    twice = spark.createDataFrame([(1, "first word"), (1, "other word"), (2, "none")], "id long, text string")
    r = rules.rules_of([{"rule_id": "a", "label": "A", "conditions": [{"field": "text", "operator": "contains", "value": "word"}]}])
    assert gram_index.GramIndex.build(twice, "id", ["text"]).prefilter(twice, r).count() == 2


@pytest.mark.parametrize("seed", range(3))
def test_index_equals_columns(spark, seed):
    rng = random.Random(seed)
    df = table(spark, rng).drop("id").withColumn("n", F.monotonically_increasing_id())
    some = random_rules(rng, 120)
    plain = [r for r in some if not any(c.source for c in r.conditions)]
    want = {r["n"]: r["rule_ids"] for r in rules.tag_rows(df, plain).collect()}
    assert {r["n"]: list(r["rule_ids"]) for r in RuleIndex(spark, plain).tag_rows(df).collect()} == want
    assert any(want.values())
    long = rules.long_fields(df, ["n"], ["a", "b"]).withColumn("source", F.when(F.col("n") % 2 == 0, "s1").otherwise("s2"))
    for any_field in (False, True):
        one = rules.match_indicators(long, ["n"], some, any_field)
        two = RuleIndex(spark, some).match_indicators(long, ["n"], any_field)
        key = lambda t: sorted((r["n"], r["rule_id"], r["total"], r["matched"]) for r in t.collect())
        assert key(one) == key(two)


def test_many_conditions(spark):
    """More conditions than a word has bits, in both forms."""
    df = spark.createDataFrame([(1, "s", "f", f"v{i}") for i in range(0, 200, 2)] + [(2, "s", "f", "v1")], "k long, source string, field string, value string")
    r = rules.rules_of([{"rule_id": "big", "label": "x", "conditions": [{"field": "f", "value": f"v{i}"} for i in range(150)]}, {"rule_id": "small", "label": "x", "conditions": [{"field": "f", "value": "v1"}]}])
    for got in (rules.match_indicators(df, ["k"], r), RuleIndex(spark, r).match_indicators(df, ["k"])):
        assert sorted((x["k"], x["rule_id"], x["total"], x["matched"]) for x in got.collect()) == [(1, "big", 150, 75), (2, "big", 150, 1), (2, "small", 1, 1)]


def test_five_thousand_rules_of_two_hundred_conditions(spark):
    rng = random.Random(3)
    some = rules.rules_of([{"rule_id": f"r{i}", "label": "x", "logic": "OR", "min_indicators": 3, "conditions": [{"field": rng.choice("ab"), "operator": "contains", "value": f"{rng.randrange(20_000):05}"} if j % 2 else {"field": "n", "operator": ">", "value": 1000 + rng.randrange(10**6)} for j in range(200)]} for i in range(5000)])
    rows = [("".join(rng.choice("0123456789") for _ in range(60)), "".join(rng.choice("0123456789") for _ in range(60)), rng.randrange(4000)) for _ in range(8)]
    got = RuleIndex(spark, some).tag_rows(spark.createDataFrame(rows, "a string, b string, n int")).collect()
    for g, (a, b, n) in zip(got, rows, strict=True):
        have = {"a": a, "b": b}
        met = lambda c: n > c.value if c.operator == ">" else c.value in have[c.field]  # noqa: B023, E731
        assert list(g["rule_ids"]) == sorted(r.rule_id for r in some if sum(map(met, r.conditions)) >= 3)
    assert any(g["rule_ids"] for g in got)


def test_no_rules(spark):
    df = spark.createDataFrame([(1, "x")], "k long, a string")
    assert RuleIndex(spark, []).tag_rows(df).first()["rule_ids"] == []
    assert RuleIndex(spark, random_rules(random.Random(1), 5)).tag_rows(df.filter("false").withColumn("b", F.lit("x"))).count() == 0
