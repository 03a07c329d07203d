"""Starts of fixed-origin clusters take no more than a running value an instant."""

from pyspark.sql import functions as F

from evspark.operators import ordered


def test_starts_of_many_instants_in_a_bucket(spark):
    """20,000 instants of one bucket's width: no frame of the window is taken anew for each row."""
    df = spark.range(20_000).select("id", F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    got = ordered.fixed_origin(df, [], "ts", "id", 7)
    assert sorted(r[0] for r in got.groupBy("cluster_start").count().select("count").collect()) == [5998, 7001, 7001]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()
