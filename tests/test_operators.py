"""Operators against plain Python on small tables, and properties that must hold."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evspark.operators import aggs, correlate, joins, ordered, rules, search
from evspark.sources import io
from evspark.sources.store import ResultStore

T0 = datetime(2024, 1, 1)


def rows(n=200, seed=1, users=4, span=40_000):
    rng = random.Random(seed)
    return [(i, T0 + timedelta(seconds=rng.randint(0, span)), rng.randint(0, users - 1), rng.choice("abc")) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "event_id long, ts timestamp, user_id long, source string")


def test_band_join_equals_range_join(spark):
    data = rows()
    df = frame(spark, data)
    a = df.select(F.col("event_id").alias("a"), F.col("ts").alias("at"))
    b = df.select(F.col("event_id").alias("b"), F.col("ts").alias("bt"))
    got = sorted((r["a"], r["b"]) for r in joins.band_join(a, b, 300, "at", "bt").collect())
    want = sorted((x[0], y[0]) for x, y in itertools.product(data, data) if abs((x[1] - y[1]).total_seconds()) <= 300)
    assert got == want


@pytest.mark.parametrize(("seed", "steps"), [(1, 6), (2, 0), (3, 1)])
def test_fixed_origin_equals_fold(spark, seed, steps, monkeypatch):
    monkeypatch.setattr(ordered, "STEPS", steps)
    data = rows(seed=seed)
    got = {(r["event_id"], r["cluster_start"]) for r in ordered.fixed_origin(frame(spark, data).orderBy(F.rand(seed)), ["user_id"], "ts", "event_id", 900).collect()}
    want = set()
    for u in {x[2] for x in data}:
        origin = None
        for x in sorted((x for x in data if x[2] == u), key=lambda x: (x[1], x[0])):
            if origin is None or (x[1] - origin).total_seconds() > 900:
                origin = x[1]
            want.add((x[0], origin))
    assert got == want


def test_global_islands_equal_a_scan(spark):
    data = rows(span=400_000)
    got = {r["event_id"]: r["island"] for r in ordered.global_islands(frame(spark, data), "ts", 1800, ["event_id"], slice_seconds=7200).collect()}
    island, last, want = 0, None, {}
    for x in sorted(data, key=lambda x: (x[1], x[0])):
        if last is not None and (x[1] - last).total_seconds() > 1800:
            island += 1
        want[x[0]], last = island, x[1]
    first = min(got.values())
    assert {k: v - first for k, v in got.items()} == want


def test_windows_cover_all_rows_and_closed_ends_count_twice(spark):
    df = frame(spark, [(1, T0, 1, "a"), (2, T0 + timedelta(hours=1), 1, "a"), (3, None, 1, "a")])
    left = correlate.windows(df, "ts", 3600)
    assert left.count() == 2
    assert correlate.windows(df, "ts", 3600, closed="both").filter("event_id = 2").count() == 2


def test_interval_join_gives_each_pair_once(spark):
    rng = random.Random(5)
    spans = lambda n: [(i, T0 + timedelta(minutes=(s := rng.randint(0, 5000))), T0 + timedelta(minutes=s + rng.randint(0, 900))) for i in range(n)]
    x, y = spans(60), spans(60)
    a, b = spark.createDataFrame(x, "a int, s timestamp, e timestamp"), spark.createDataFrame(y, "b int, s2 timestamp, e2 timestamp")
    got = sorted((r["a"], r["b"]) for r in joins.interval_join(a, b, "s", "e", "s2", "e2", 3600).collect())
    assert got == sorted((p[0], q[0]) for p in x for q in y if p[1] <= q[2] and p[2] >= q[1])


def test_parent_paths_guard_circles(spark):
    df = spark.createDataFrame([(5, 5, "root"), (6, 5, "a"), (7, 6, "b"), (8, 99, "lost"), (9, 10, "x"), (10, 9, "y")], "id long, parent_id long, name string")
    got = {r["id"]: r["path"] for r in joins.parent_paths(df).collect()}
    assert got == {5: ".", 6: "./a", 7: "./a/b", 8: "[Unknown Parent: 99]/lost", 9: "[Unknown]", 10: "[Unknown]"}


def test_scores_stay_in_range(spark):
    df = spark.createDataFrame([(1, 0.0, ["a", None], []), (5, 1e9, ["a"] * 5, ["x"] * 5), (0, 0.0, [], None)], "n int, s double, a array<string>, p array<string>")
    for r in df.select(correlate.match_score(F.col("n"), 5, F.col("s"), 900, F.col("a"), F.col("p"))["score"].alias("x"), correlate.match_confidence(F.col("s"), 900, F.col("a"), F.col("p"))["confidence"].alias("y")).collect():
        assert 0 <= r["x"] <= 1 and 0 <= r["y"] <= 1


def test_rules_need_a_condition_and_scopes_win():
    got = rules.rules_of([{"rule_id": "a", "label": "A", "conditions": []}, {"rule_id": "b", "label": "B", "conditions": [{"field": "x"}]}])
    assert [r.rule_id for r in got] == ["b"]
    two = rules.rules_of([{"rule_id": "b", "label": s, "scope": s, "conditions": [{"field": "x"}]} for s in ("global", "wing", "pipeline")])
    assert [r.label for r in rules.rules_for(two)] == ["wing"]
    with pytest.raises(ValueError):
        rules.rules_of([{"rule_id": "", "label": "x"}])


def test_weights(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    got = correlate.effective_weights(df([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z")], "source string, artifact_type string"), df([("a", 0.9), ("b", 0.0)], "source string, weight double"), df([("x", 0.5)], "artifact_type string, weight double"), df([("y", 0.3)], "artifact_type string, weight double"))
    assert {r["source"]: r["weight"] for r in got.collect()} == {"a": 0.9, "b": 0.5, "c": 0.3, "d": 0.1}


def test_audit_summary(spark):
    df = spark.createDataFrame([("2024-01-01 10:00 [cut] x",), ("2024-01-02 10:00 [cut] y",), ("noise",)], "value string")
    assert [tuple(r) for r in aggs.audit_summary(df).collect()] == [("cut", 2, "2024-01-01 10:00", "2024-01-02 10:00")]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", [1, 2]), (2, None, [])], "i int, s string, l array<int>")
    for fmt in ("json", "csv", "xml"):
        io.export(df, f"{tmp_path}/{fmt}", fmt)
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert io.read_delimited(spark, f"{tmp_path}/csv").columns == ["i", "s", "l"]
    assert io.read_delimited(spark, f"{tmp_path}/csv", header=False).columns == ["Column_1", "Column_2", "Column_3"]
    assert spark.read.format("xml").option("rowTag", "match").load(f"{tmp_path}/xml").count() == 2
    store = ResultStore(spark, f"{tmp_path}/store")
    store.append("matches", df.withColumn("execution_id", F.lit(7)))
    assert store.read("matches", 7).count() == 2


def test_nested_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": {"b": [{"c": 1}, {"c": 2}]}, "d": "t"}\n')
    df = io.read_json(spark, str(tmp_path / "x.json"))
    assert io.key_paths(df.schema) == ["a.b.c", "d"]
    assert df.select(io.nested(df.schema, "a.b.c")).first()[0] == 1


def test_clean_names():
    assert io.clean_names(["a b", "A-b", "1x", "", "a b"]) == ["a_b", "A_b_2", "c_1x", "column", "a_b_3"]


def test_indicator_files(spark, tmp_path):
    (tmp_path / "i.csv").write_text("v|k\nx|1\n |2\n")
    assert [tuple(r) for r in io.read_indicators(spark, str(tmp_path / "i.csv"), "v", "k", "ioc", delimiter="pipe").collect()] == [("x", "1", "ioc")]


def test_stream_store(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "i int")
    df.write.parquet(f"{tmp_path}/in")
    q = ResultStore(spark, f"{tmp_path}/s").append_stream("m", spark.readStream.schema("i int").parquet(f"{tmp_path}/in"), f"{tmp_path}/c")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/s/m").count() == 2


def test_vector_topk_has_no_bound_on_queries(spark):
    import math

    rng = random.Random(7)
    vecs = {i: [rng.uniform(-1, 1) for _ in range(6)] for i in range(60)}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {(q, n + 1, i) for q in vecs for n, i in enumerate(sorted((i for i in vecs if i != q and cos(vecs[i], vecs[q]) > 0.1), key=lambda i: (-cos(vecs[i], vecs[q]), i))[:3])}
    df = spark.createDataFrame(list(vecs.items()), "id long, v array<double>")
    for most in (7, 1000):
        got = search.vector_topk(df, df, "id", "v", 3, 0.1, most_queries=most)
        assert {(r["query_id"], r["rank"], r["id"]) for r in got.collect()} == want


def test_find_in_text_gives_offsets_in_any_script(spark):
    import re

    texts = ["The the, THE", "éthe thé the", "other the_x 𝄞 the\nthe", "中the the中 «the»", "none"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for mode, p in (("word", r"\bthe\b"), ("text", "the"), ("regex", r"(t)(?:h)e\b")):
        got = sorted((r["id"], r["place"], r["found"], r["start"], r["end"]) for r in search.find_in_text(df, "t", "the" if mode != "regex" else p, mode).collect())
        flags = re.I | (re.A if mode == "regex" else 0)
        if mode != "regex":
            assert got == sorted((i, n + 1, m[0], m.start(), m.end()) for i, t in enumerate(texts) for n, m in enumerate(re.finditer(p, t, flags)))
        assert all(texts[i][s:e] == f for i, _, f, s, e in got)
    assert {r["start"] for r in search.find_in_text(df, "t", "x*", "regex").collect()} == {None}


def test_trend_bands_and_advice(spark):
    rows = [("a", 60 * i, f"u{i % 3}", "k1") for i in range(10)] + [("b", 100_000 + 60 * i, f"v{i}", f"k{i % 4}") for i in range(30)]
    df = spark.createDataFrame(rows, "period string, t long, who string, kind string").withColumn("ts", F.timestamp_seconds("t"))
    r = aggs.trend_report(df, "period", "b", "a", "ts", "who", "kind").first()
    assert (r["activity_change"], r["identity_growth"], r["pattern"]) == ("Increased by 200.0%", "Increased by 900.0%", "Consistent activity")
    assert r["advice"] == ["activity_spike", "low_overlap", "few_common_kinds"]
    back = aggs.trend_report(df, "period", "a", "b", "ts", "who", "kind").first()
    assert back["activity_change"] == "Decreased by 66.7%" and "activity_drop" in back["advice"]
    none = aggs.trend_report(df.limit(0), "period", "a", "b", "ts", "who", "kind").first()
    assert none["activity_change"] == "Stable" and none["overlap_percent"] == 0.0


def test_search_modes():
    assert [search.search_mode(q) for q in ("yesterday", "at 13:45", "a[bc]", "Process list", "word")] == ["temporal", "temporal", "pattern", "semantic", "text"]


def test_fixed_origin_over_one_order_and_null_keys(spark):
    """Against a plain fold: long dense chains, gaps at and around the width, no key, and a null key."""
    rng = random.Random(5)
    t, rows = 0, []
    for i in range(600):
        t += rng.choice([0, 1, 5, 40, 60, 61, 120, 121, 500])
        rows.append((i, t, None if i % 3 else "k"))
    df = spark.createDataFrame(rows, "id long, t long, k string").withColumn("ts", F.timestamp_seconds("t"))

    def fold(times):
        out, start = {}, None
        for x in sorted(times):
            if start is None or x - start > 60:
                start = x
            out[x] = start
        return out

    for key in ([], ["k"]):
        want = {k: fold([t for _, t, own in rows if not key or own == k]) for k in ({None} if not key else {None, "k"})}
        got = ordered.fixed_origin(df, key, "ts", "id", 60).select("id", F.unix_timestamp("cluster_start").alias("s")).collect()
        assert {r["id"]: r["s"] for r in got} == {i: want[k if key else None][t] for i, t, k in rows}


def test_intervals_of_all_lengths(spark):
    rng = random.Random(6)
    make = lambda n, at: [(i, s := rng.randrange(10**6), s + rng.choice([0, 10, 3600, 10**5, 10**7])) for i in range(n)]
    a, b = make(80, 0), make(80, 1)
    df = lambda rows, p: spark.createDataFrame(rows, f"{p} long, x{p} long, y{p} long").select(p, F.timestamp_seconds(f"x{p}").alias(f"s{p}"), F.timestamp_seconds(f"y{p}").alias(f"e{p}"))
    got = sorted((r["a"], r["b"]) for r in joins.interval_join(df(a, "a"), df(b, "b"), "sa", "ea", "sb", "eb", 600).collect())
    assert got == sorted((i, j) for i, s, e in a for j, s2, e2 in b if s <= e2 and s2 <= e)


def test_calendar_at_month_ends_and_leap_days(spark):
    rows = [("a", "2024-02-28 23:59:59", 1), ("a", "2024-03-01 00:00:00", 2), ("b", "2023-12-31 12:00:00", 3)]
    heat = aggs.heat(spark.createDataFrame(rows, "source string, t string, n int").withColumn("ts", F.to_timestamp("t")), "source", "ts")
    got = {(r["source"], str(r["day"])): r["n"] for r in aggs.dense_days(heat).collect()}
    assert len(got) == 2 * 62 and got["a", "2024-02-29"] == 0 and got["a", "2024-02-28"] == 1 and got["a", "2024-03-01"] == 1 and got["b", "2023-12-31"] == 1


def test_overlapping_activity_is_cut_at_the_previous_end(spark):
    rows = [("x", 1000, 600.0), ("x", 1300, 900.0), ("x", 1300, 5.0), ("y", 1300, 5.0)]
    df = spark.createDataFrame(rows, "app string, t long, d double").withColumn("ts", F.timestamp_seconds("t"))
    got = sorted((r["app"], r["s"], r["e"]) for r in ordered.activity_intervals(df, ["app"], "ts", F.col("d"), tie=["d"]).select("app", F.unix_timestamp("start_ts").alias("s"), F.unix_timestamp("end_ts").alias("e")).collect())
    assert got == [("x", 400, 1000), ("x", 1280, 1300), ("x", 1300, 1300), ("y", 1280, 1300)]
