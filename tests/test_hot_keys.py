"""Operators on keys that hold most rows: the same results however fine the cuts, and no task of a whole key."""

import random
import re
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from evspark.operators import joins, ordered

T0 = datetime(2024, 1, 1)


def frame(spark, seed=1, n=300):
    rng = random.Random(seed)
    user = lambda: rng.choice([1, 1, 1, 1, 2, None])
    at = lambda: T0 + timedelta(seconds=rng.choice([rng.randint(0, 3000), rng.randint(0, 400_000)])) if rng.random() > 0.04 else None
    return spark.createDataFrame([(i, at(), user(), rng.choice("abc"), rng.choice("xyz"), rng.uniform(0, 900)) for i in range(n)], "id long, ts timestamp, u int, kind string, name string, d double").cache()


OPERATORS = {
    "islands": lambda df, n: ordered.islands(df, ["u"], "ts", 1800, ["id"], slice_rows=n).select("id", "island"),
    "gap_clusters": lambda df, n: ordered.gap_clusters(df, ["u"], "ts", 1800, slice_rows=n),
    "name_changes": lambda df, n: ordered.name_changes(df, ["u"], ["ts", "id"], ["kind", "name"], n).select("u", "kind", "name", "prev_kind", "prev_name"),
    "power_sessions": lambda df, n: ordered.power_sessions(df, ["u"], "ts", F.col("kind") == "a", F.col("kind") == "b", ["id"], n),
    "session_bands": lambda df, n: ordered.session_bands(df, ["u"], "ts", F.col("kind") == "a", F.col("kind") == "b", F.col("kind") == "c", ["id"], n),
    "sequence_gaps": lambda df, n: ordered.sequence_gaps(df.filter("d > 300"), ["u"], "id", F.lit(1), n),
    "activity_intervals": lambda df, n: ordered.activity_intervals(df, ["u"], "ts", F.col("d"), tie=["id"], slice_rows=n).select("id", "start_ts", "end_ts"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_slices_change_nothing(spark, name):
    for seed in (1, 2):
        df = frame(spark, seed)
        rows = lambda n: sorted(map(str, OPERATORS[name](df, n).collect()))  # noqa: B023, E731
        whole = rows(10**9)
        assert whole and rows(20) == whole and rows(3) == whole


@pytest.mark.parametrize("name", OPERATORS)
def test_no_window_over_rows_has_the_key_alone(spark, name):
    plan = OPERATORS[name](frame(spark), 20)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if re.search(r"\bWindow \[", line)]
    assert windows
    for w in windows:
        # by slice, or over the slices: one row each
        assert re.search(r"\], \[(?:__k#\d+, )?__slice#\d+L?\], \[", w) or re.search(r"\], \[__k#\d+\], \[__slice#\d+L? ASC", w), w


def test_crowded_second_is_spread(spark):
    """One second holds half of the rows of both sides: every pair once, and cells of even size."""
    rng = random.Random(3)
    at = lambda i: T0 + timedelta(seconds=0 if i % 2 else rng.randint(0, 90_000))
    a = spark.createDataFrame([(i, at(i)) for i in range(400)], "a long, at timestamp").cache()
    b = spark.createDataFrame([(i, at(i)) for i in range(500)], "b long, bt timestamp").cache()
    pairs = lambda **k: joins.band_join(a, b, 60, "at", "bt", **k)
    want = sorted(map(tuple, pairs(side=10**9).select("a", "b").collect()))
    got = pairs(side=30)
    assert sorted(map(tuple, got.select("a", "b").collect())) == want and len(want) == len(set(want)) > 50_000
    x, y, keys = joins.cells(a.withColumn("k", F.lit(1)), b.withColumn("k", F.lit(1)), ["k"], 30)
    assert keys == ["k", "__line", "__column"] and x.join(y, keys).count() == 400 * 500
    sizes = [r["count"] for r in x.groupBy(*keys).count().collect()]
    assert len(sizes) == 14 * 17 and max(sizes) < 80


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
def test_ordered_pairs_pack_into_runs(spark, tmp_path, broadcast):
    """40 copies of each row: the same pairs in any order, in long runs of equal distances if both sides come in order."""
    rng = random.Random(8)
    at = [T0 + timedelta(microseconds=rng.randint(0, 7_200_000_000)) for _ in range(60)]
    a = spark.createDataFrame([(1000 * k + i, t) for k in range(40) for i, t in enumerate(at[:20])], "a long, at timestamp")
    b = spark.createDataFrame([(1000 * k + i, t) for k in range(40) for i, t in enumerate(at[20:])], "b long, bt timestamp")
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        got = {}
        for name, order, side in (("plain", None, 10_000), ("runs", (["at", "a"], ["bt", "b"]), 10_000), ("cells", (["at", "a"], ["bt", "b"]), 300)):
            joins.band_join(a, b, 900, "at", "bt", side=side, order=order).select("a", "b", "dt_s").coalesce(1).write.parquet(str(tmp_path / name))
            t = spark.read.parquet(str(tmp_path / name))
            got[name] = t.count(), t.distinct().count(), t.selectExpr("sum(xxhash64(a, b, dt_s) % 1000000007)").first()[0]
            rows = [r for f in sorted((tmp_path / name).glob("*.parquet")) for r in pq.read_table(f)["dt_s"].to_pylist()]
            got[name, "runs"] = 1 + sum(x != y for x, y in zip(rows, rows[1:], strict=False))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)
    assert got["plain"] == got["runs"] == got["cells"] and got["plain"][0] == got["plain"][1] > 100_000
    pairs = got["plain"][0]
    assert got["plain", "runs"] > pairs / 2 and got["runs", "runs"] <= pairs / 30 and got["cells", "runs"] < pairs / 3


def test_pairs_by_way_of_lists(spark, tmp_path):
    """The rows of band_join, each as often, on ties, nulls, crowded instants and repeated rows; copies come out in longer runs."""
    rng = random.Random(9)
    at = lambda: rng.choice([T0, None, *[T0 + timedelta(seconds=60 * rng.randint(0, 90), microseconds=rng.randint(0, 1)) for _ in range(4)]])
    a = spark.createDataFrame([(rng.choice([None, *range(50)]), f"x{i % 3}", at()) for i in range(150)], "a long, ax string, at timestamp").cache()
    b = spark.createDataFrame([(at(), i // 2, rng.choice("xyz")) for i in range(300)], "bt timestamp, b long, kind string").cache()
    of = lambda df: sorted(map(str, df.collect()))
    want = joins.band_join(a, b, 300, "at", "bt")
    for how in ({}, {"side": 20}, {"task_rows": 10}, {"side": 20, "task_rows": 10}):
        got = joins.band_join_lists(a, b, 300, "at", "bt", **how)
        assert got.columns == want.columns and of(got) == of(want), how
    assert joins.band_join_lists(a.filter("a < 0"), b, 300, "at", "bt").count() == 0 == joins.band_join_lists(a, b.limit(0), 300, "at", "bt").count()
    times = [T0 + timedelta(microseconds=rng.randint(0, 7_200_000_000)) for _ in range(60)]
    a = spark.createDataFrame([(1000 * k + i, t) for k in range(60) for i, t in enumerate(times[:20])], "a long, at timestamp")
    b = spark.createDataFrame([(1000 * k + i, t) for k in range(60) for i, t in enumerate(times[20:])], "b long, bt timestamp")
    tables = {"order": joins.band_join(a, b, 900, "at", "bt", order=(["at", "a"], ["bt", "b"])), "lists": joins.band_join_lists(a, b, 900, "at", "bt")}
    pairs, runs = {}, {}
    for name, df in tables.items():
        df.select("a", "b", "dt_s").write.parquet(str(tmp_path / name))
        gaps = [pq.read_table(f)["dt_s"].to_pylist() for f in sorted((tmp_path / name).glob("*.parquet"))]
        pairs[name], runs[name] = sum(map(len, gaps)), sum(1 + sum(x != y for x, y in zip(g, g[1:], strict=False)) for g in gaps if g)
    assert pairs["lists"] == pairs["order"] > 100_000
    assert runs["order"] > pairs["order"] / 100 and runs["lists"] < pairs["lists"] / 2000  # 60 pairs a run, and 60 times 60


def test_the_query_of_all_pairs_goes_by_lists(spark):
    from evspark.plans import registry

    plan = registry.QUERIES["band_join_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("collect_list") == 2 and "Broadcast" not in plan.executedPlan().toString()


def test_long_intervals_meet_points_in_cells(spark):
    rng = random.Random(6)
    spans = [(i, T0 + timedelta(minutes=(s := rng.randint(0, 50_000))), T0 + timedelta(minutes=s + rng.choice([1, 30, 40_000, 2_000_000]))) for i in range(40)]
    days = [(i, T0 + timedelta(minutes=(s := rng.randint(0, 60_000))), T0 + timedelta(minutes=s)) for i in range(400)]
    a, b = spark.createDataFrame(spans, "a int, s timestamp, e timestamp"), spark.createDataFrame(days, "b int, s2 timestamp, e2 timestamp")
    got = sorted((r["a"], r["b"]) for r in joins.interval_join(a, b, "s", "e", "s2", "e2", 3600, side=25).collect())
    assert got == sorted((p[0], q[0]) for p in spans for q in days if p[1] <= q[2] and p[2] >= q[1])


def test_first_row_of_a_key_stays(spark):
    df = spark.createDataFrame([(1, "a", 3, [1]), (1, "a", 1, [2]), (1, "b", 2, [3]), (None, "a", 1, [4]), (None, "a", 1, [4])], "k int, f string, n int, x array<int>")
    got = sorted((str(r["k"]), r["f"], r["n"], r["x"]) for r in joins.insert_or_ignore(df, ["k", "f"], ["n"]).collect())
    assert got == [("1", "a", 1, [2]), ("1", "b", 2, [3]), ("None", "a", 1, [4]), ("None", "a", 1, [4])]


def test_large_configuration_is_left_to_a_shuffle(spark):
    assert joins.config_table(spark.range(10), 5).count() == 10
    plan = lambda most: spark.range(100).join(joins.config_table(spark.range(10), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10) and "strategy=broadcast" not in plan(9)


def test_deep_chains_and_circles(spark):
    n = 300
    rows = [(5, 5, "root"), *[(i, i - 1 if i > 6 else 5, f"n{i}") for i in range(6, n)], (900, 901, "x"), (901, 900, "y"), (902, 900, "z")]
    got = {r["id"]: r["path"] for r in joins.parent_paths(spark.createDataFrame(rows, "id long, parent_id long, name string")).collect()}
    assert got[n - 1] == "/".join([".", *[f"n{i}" for i in range(6, n)]])
    assert got[900] == got[901] == got[902] == "[Unknown]"
