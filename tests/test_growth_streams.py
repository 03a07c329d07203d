"""SS-06 over larger inputs: state partitions stay few, and a step of arriving rows is written by several tasks."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from evspark.plans import registry
from evspark.streaming import run, stream

DATA = "/root/testdata/sf0.001"


def test_state_partitions_do_not_follow_the_session(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(run, "fresh_path", lambda spark: str(tmp_path / "out"))
    spark.range(20).select(F.lit("a").alias("kind"), F.timestamp_seconds("id").alias("at")).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get(run.PARTITIONS)
    spark.conf.set(run.PARTITIONS, 60)
    try:
        got = run.to_end(stream.event_counts(run.read_files(spark, str(tmp_path / "in")), "at", "kind", "1 hour"), "complete").collect()
        assert spark.conf.get(run.PARTITIONS) == "60"
    finally:
        spark.conf.set(run.PARTITIONS, before)
    assert [r["n"] for r in got] == [20]
    assert len([x for x in os.listdir(tmp_path / "out/state/state/0") if x.isdigit()]) == 2 * spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["stream_open_close", "stream_open_close_late"])
def test_steps_of_several_files(spark, monkeypatch, name):
    """A step is spread over files, in equal number for each, and the sessions are the same."""
    from evspark.plans import q_stream

    rows = lambda: collections.Counter(map(tuple, registry.QUERIES[name](spark, DATA).collect()))
    whole = rows()
    monkeypatch.setattr(q_stream, "FILE_ROWS", 40)
    path, parts = q_stream.dealt(spark, DATA, F.lit(0), 3)
    files = [x for x in os.listdir(path) if x.endswith(".parquet")]
    assert parts > 5 and len(files) == parts * 4
    assert whole and rows() == whole
