"""Rows near an anchor without its pairs: equal to the operators on pairs, on ties, nulls and crowded instants."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evspark.operators import joins, near

T0 = datetime(2024, 1, 1)


def sides(spark, seed, n=400):
    """Whole minutes, so that times tie, a crowded instant, rows without a time, lone rows."""
    rng = random.Random(seed)
    at = lambda: rng.choice([T0, None, *[T0 + timedelta(seconds=60 * rng.randint(0, 90)) for _ in range(9)], T0 + timedelta(days=rng.randint(1, 9), microseconds=rng.randint(0, 9))])
    a = spark.createDataFrame([(i, at(), f"p{i % 3}") for i in range(n // 4)], "a long, a_ts timestamp, a_x string").cache()
    b = spark.createDataFrame([(n - i, at(), rng.choice(["x", "y", "z", None]), f"q{i % 5}") for i in range(n)], "b long, b_ts timestamp, kind string, b_x string").cache()
    return a, b


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_and_reach_equal_pairs(spark, seed):
    a, b = sides(spark, seed)
    pairs = joins.band_join(a, b, 300, "a_ts", "b_ts")
    columns = ["a", "a_ts", "a_x", "b", "b_ts", "kind", "b_x", "dt_s"]
    want = rows(joins.nearest(pairs, "a", "b", ["kind"]), *columns)
    assert want and rows(near.nearest_rows(a, b, 300, "a", "a_ts", "b", "b_ts", "kind"), *columns) == want
    far = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("dt_s").alias("spread_s"))
    assert rows(near.reach(a, b, 300, "a", "a_ts", "b_ts"), "a", "n", "spread_s") == rows(far, "a", "n", "spread_s")


def test_nearest_row_without_a_key_keeps_its_columns(spark):
    """It is found like any other, with its source; of rows equally near it is the last."""
    at = lambda s: T0 + timedelta(seconds=s)
    a = spark.createDataFrame([(1, at(0)), (2, at(1000)), (None, at(2000))], "a long, a_ts timestamp")
    b = spark.createDataFrame([(None, at(5), "x"), (None, at(1010), "x"), (8, at(990), "x"), (9, at(1010), "y"), (None, at(1010), "y"), (None, at(2000), "z")], "b long, b_ts timestamp, kind string")
    got = {tuple(r) for r in near.nearest_rows(a, b, 300, "a", "a_ts", "b", "b_ts", "kind").select("a", "kind", "b", "dt_s").collect()}
    assert got == {(1, "x", None, 5.0), (2, "x", 8, 10.0), (2, "y", 9, 10.0), (None, "z", None, 0.0)}


@pytest.mark.parametrize(("most", "crowd"), [(100, 500_000), (7, 500_000), (7, 20)])
def test_combinations_equal_pairs(spark, most, crowd):
    for seed in (1, 2):
        a, b = sides(spark, seed)
        columns = ["a", "n_sources", "combo_no", "swapped", "swap_row"]
        want = rows(joins.match_combinations(joins.band_join(a, b, 300, "a_ts", "b_ts"), "a", "kind", "b", 2, most), *columns)
        assert want and rows(near.combinations(a, b, 300, "a", "a_ts", "kind", "b", "b_ts", 2, most, crowd), *columns) == want


@pytest.mark.parametrize("at_once", [1, 20])
def test_totals_equal_pairs(spark, at_once):
    _, b = sides(spark, 4)
    e = b.select(F.col("b").alias("event_id"), F.col("b_ts").alias("ts"), F.col("kind").alias("source"))
    want = joins.correlate_all(e, 300).groupBy("anchor_source", "row_source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(joins.us("row_ts") - joins.us("anchor_ts"))).alias("total_us"))
    columns = ["anchor_source", "row_source", "n", "total_us"]
    assert rows(near.pair_totals(e, 300, at_once=at_once), *columns) == rows(want, *columns)


@pytest.mark.parametrize("name", ["nearest_other_source", "match_combos", "match_best_combo", "match_integrity", "all_anchor_pairs"])
def test_queries_shuffle_no_pairs(spark, name):
    """The old form's rows in shuffles were the pairs: here the plan has no join of anchors with rows."""
    from evspark.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Join Inner" in line and "__bucket" in line for line in plan.splitlines())


def test_close_pairs_are_the_pairs_that_score(spark):
    """Scores from nearness and equal columns: no pair is lost or met twice, crowded buckets and nulls included, and far
    fewer pairs are met than lie in the window."""
    from evspark.operators import correlate

    rng = random.Random(8)
    some = [(i, T0 + timedelta(seconds=rng.choice([0, 120, 240, 360, 480, 600, rng.randint(0, 6000)]), microseconds=rng.choice([0, 0, 1])), rng.choice([None, *range(9)]), rng.choice([None, *"pqrst"]), rng.choice("xyz")) for i in range(400)]
    df = spark.createDataFrame(some, "event_id long, ts timestamp, u long, k string, t string").cache()
    score = correlate.pair_score("a_ts", "b_ts", 600, F.col("a_u") == F.col("b_u"), F.col("a_k") == F.col("b_k"), F.col("a_t") == F.col("b_t"))
    of = lambda d: sorted((tuple(r) for r in d.select("a_event_id", "b_event_id", "a_ts", "b_k", "dt_s", "score").collect()), key=str)
    want = of(joins.pair_scores(df, 600, score, 0.5))
    for side in (10_000, 20):
        assert of(joins.pair_scores(df, 600, score, 0.5, near=0.5, alike={"u": 0.2, "k": 0.2, "t": 0.1}, side=side)) == want, side
    met = joins.close_pairs(df, 600, 0.5, "event_id", "ts", 0.5, {"u": 0.2, "k": 0.2, "t": 0.1})
    every = joins.band_join(df.select(F.col("ts").alias("a")), df.select(F.col("ts").alias("b")), 600, "a", "b").count()
    assert met.count() < every / 4
