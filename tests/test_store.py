"""Stores and databases: reruns, snapshots, failed writes, pushed filters; sessions of a stream for any split."""

import os
import random
import sqlite3
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evspark.sources import sqlite
from evspark.sources.store import ResultStore
from evspark.streaming import stream
from evspark.streaming.run import read_files, to_end

T0 = datetime(2024, 1, 1)


def test_commits(spark, tmp_path):
    store = ResultStore(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError, match="nothing"):
        store.read("m")
    one = spark.createDataFrame([("007", 1), ("007", 2)], "execution_id string, a int")
    assert (store.append("m", one), store.append("m", one)) == (1, 2)
    assert store.read("m").count() == 2 and store.read("m", "007").count() == 2 and store.read("m", "7").count() == 0
    store.append("m", spark.createDataFrame([("8", 3, 0.5)], "execution_id string, a int, score double"))
    assert sorted(map(tuple, store.read("m").collect()), key=str) == [("007", 1, None), ("007", 2, None), ("8", 3, 0.5)]
    snapshot = store.read("m")
    with pytest.raises(Exception, match="boom"):
        store.commit("m", one.withColumn("b", F.raise_error(F.lit("boom"))), "x")
    assert store.version("m") == 3 and store.read("m").count() == 3
    store.append("m", one.limit(1))
    assert store.read("m").count() == 2 and store.read("m", as_of=3).count() == 3 and snapshot.count() == 3


def test_stream_and_batch_share_a_table(spark, tmp_path):
    store = ResultStore(spark, f"{tmp_path}/s")
    store.append("m", spark.createDataFrame([(1, 10)], "execution_id int, i int"))
    spark.createDataFrame([(2, 20), (2, 21)], "execution_id int, i int").write.parquet(f"{tmp_path}/in")
    found = spark.readStream.schema("execution_id int, i int").parquet(f"{tmp_path}/in")
    store.append_stream("m", found, f"{tmp_path}/c").awaitTermination()
    store.append_stream("m", found, f"{tmp_path}/c").awaitTermination()
    store.commit("m", spark.createDataFrame([(2, 20), (2, 21)], "execution_id int, i int"), f"{tmp_path}/c 0")  # a batch that is run again
    assert sorted(tuple(r) for r in store.read("m").collect()) == [(1, 10), (2, 20), (2, 21)]


def test_sqlite_types_ranges_and_filters(spark, tmp_path):
    file = f"{tmp_path}/a b.db"
    with sqlite3.connect(file) as db:
        db.execute('create table "t x" (i integer, r real, s text collate nocase, b blob, d datetime)')
        db.executemany('insert into "t x" values (?, ?, ?, ?, ?)', [(1, 1.5, "a", b"x", "2024-01-01"), (2, 2, "A", None, 7), ("bad", None, "é", b"", None), (None, "z", 5, "text", "x"), (5, float("inf"), None, b"y", "")])
        db.execute('create view v as select i, s from "t x"')
        db.execute("create table w (k text primary key, n integer) without rowid")
        db.execute("insert into w values ('p', 1), ('q', 2)")
    db.close()
    df = sqlite.read_database(spark, file, "t x", rows=2)
    assert df.rdd.getNumPartitions() == 3
    assert df.dtypes == [("i", "bigint"), ("r", "double"), ("s", "string"), ("b", "binary"), ("d", "string")]
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()]
    assert got == [(1, 1.5, "a", b"x", "2024-01-01"), (2, 2.0, "A", None, "7"), (None, None, "é", b"", None), (None, None, "5", None, "x"), (5, float("inf"), None, b"y", "")]
    plain = spark.createDataFrame(df.collect(), df.schema)
    for cond in ("i > 1", "i = 2 and r >= 2", "s = 'a'", "s = '5'", "s > 'A'", "i in (1, 5)", "d is not null", "r < 2", "i is null", "s is not null and i <= 2", "s like 'A%'"):
        assert sorted(map(str, df.filter(cond).collect())) == sorted(map(str, plain.filter(cond).collect())), cond
    plan = df.filter("i > 1").select("r")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter" not in plan and "- Filter" not in plan  # the files' own query does it
    assert sqlite.read_database(spark, file, "v").count() == 5
    assert sorted(map(tuple, sqlite.read_database(spark, file, "w").collect())) == [("p", 1), ("q", 2)]
    with pytest.raises(Exception, match="no table"):
        sqlite.read_database(spark, file, "nowhere").count()


def test_sqlite_folder(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") / 4).alias("x"), F.concat(F.lit("n"), "id").alias("s"), F.lit(T0).cast("timestamp").alias("t"))
    sqlite.write_database(df.repartition(3), f"{tmp_path}/d", "t")
    names = os.listdir(f"{tmp_path}/d")
    assert len(names) == 3 and all(n.endswith(".sqlite") for n in names)
    back = sqlite.read_database(spark, f"{tmp_path}/d", "t", rows=10)
    assert back.rdd.getNumPartitions() >= 10
    assert sorted(tuple(r) for r in back.select("id", "x", "s").collect()) == [(i, i / 4, f"n{i}") for i in range(100)]
    assert back.filter("id >= 90").count() == 10


def sessions(spark, path, files, **how):
    """Files as they arrive, one a batch, then two far in the future."""
    schema = "key string, at timestamp, kind string"
    for n, rows in enumerate([*files, [(None, T0 + timedelta(days=90), "end")], [(None, T0 + timedelta(days=90), "end")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01 * (n == 0))
    df = read_files(spark, path, 1)
    got = to_end(stream.open_close_sessions(df, "at", "key", F.col("kind") == "open", F.col("kind") == "close", **how)).collect()
    utc = lambda t: t and t.replace(tzinfo=timezone.utc).timestamp() if t is None or t.tzinfo is None else t.timestamp()
    return sorted((r["key"], utc(r["start_ts"]), utc(r["end_ts"]) or 0, r["end_kind"]) for r in got)


def test_sessions_are_the_same_for_every_split(spark, tmp_path):
    rng = random.Random(4)
    minute = lambda m: T0 + timedelta(minutes=m)
    rows = [("v", minute(0), "open"), ("v", minute(2), "close"), ("v", minute(3), "open"), ("v", minute(5), "close"), ("v", minute(5), "open")]
    rows += [(k, minute(rng.choice([rng.randint(0, 300), rng.randint(0, 9000)])), rng.choice(["open", "close", "other"])) for k in "ab" for _ in range(40)]
    rows = sorted(set(rows), key=lambda r: r[1])
    # opener before closer at one time; a session without an event for a day is ongoing
    want, held = [], {}
    for k, t, kind in sorted((r for r in rows if r[2] != "other"), key=lambda r: (r[0], r[1], r[2] == "close")):
        start, last = held.get(k, (None, None))
        if start and t - last > timedelta(days=1):
            want.append((k, start.replace(tzinfo=timezone.utc).timestamp(), 0, "ongoing"))
            start = None
        if kind == "open":
            start = start or t
        elif start:
            want.append((k, start.replace(tzinfo=timezone.utc).timestamp(), t.replace(tzinfo=timezone.utc).timestamp(), "closed"))
            start = None
        held[k] = (start, t)
    want += [(k, s.replace(tzinfo=timezone.utc).timestamp(), 0, "ongoing") for k, (s, _) in held.items() if s]
    for seed, n in ((1, 1), (2, 3), (3, 5)):
        late = random.Random(seed)
        came = sorted(rows, key=lambda r: r[1] + timedelta(minutes=late.randint(0, 120)))
        step = -(-len(came) // n)
        files = [came[i : i + step] for i in range(0, len(came), step)]
        assert sessions(spark, f"{tmp_path}/{seed}", files, late="3 hours", ongoing_s=86_400) == sorted(want), n
