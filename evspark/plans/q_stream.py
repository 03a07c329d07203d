"""Queries: streams over the events files, checked against the batch results."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from evspark.operators.rule_index import RuleIndex
from evspark.plans.q_text import MANY_RULES, RULE_SQL, RULES
from evspark.plans.registry import ORACLES, query
from evspark.plans.tables import load, plain
from evspark.storage import fresh_path
from evspark.streaming import stream
from evspark.streaming.run import read_files, to_end


def events_stream(spark, sf_dir):
    return read_files(spark, f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "source")


@query("stream_counts", "SELECT make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS window_start, make_timestamp(epoch_us(ts) // 3600000000 * 3600000000 + 3600000000) AS window_end, event_type AS source, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark, sf_dir):
    """SS-01"""
    return plain(to_end(stream.event_counts(events_stream(spark, sf_dir), "ts", "source", "1 hour"), "complete"))


@query("stream_sessions", """
WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 10800000000 THEN 1 ELSE 0 END AS n_ FROM events),
i AS (SELECT *, sum(n_) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n FROM i GROUP BY user_id, island""")
def stream_sessions(spark, sf_dir):
    """SS-02"""
    return plain(to_end(stream.session_anchors(events_stream(spark, sf_dir), "ts", "user_id", 10_800), "complete"))


@query("stream_distinct", "SELECT user_id, event_type AS source, props, count(DISTINCT date_trunc('second', ts)) AS n FROM events GROUP BY ALL")
def stream_distinct(spark, sf_dir):
    """SS-03: repeats of (user, source, props, second) dropped"""
    e = events_stream(spark, sf_dir).withColumn("sec", F.date_trunc("second", "ts"))
    return to_end(stream.without_repeats(e, "ts", ["user_id", "source", "props", "sec"]).select("user_id", "source", "props")).groupBy("user_id", "source", "props").agg(F.count(F.lit(1)).alias("n"))


@query("stream_matches", """
SELECT a.event_id AS click_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1800 SECOND AND a.ts + INTERVAL 1800 SECOND WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def stream_matches(spark, sf_dir):
    """SS-04"""
    e = lambda s: events_stream(spark, sf_dir).filter(F.col("source") == s).select("event_id", "user_id", "ts")
    j = stream.interval_match(e("click"), e("purchase"), "ts", "ts", "user_id", 1800)
    return to_end(j.select(F.col("a.event_id").alias("click_id"), F.col("b.event_id").alias("purchase_id")))


@query("stream_tags", f"SELECT event_id, array_to_string(list_filter({RULE_SQL}, lambda x: x IS NOT NULL), ',') AS rule_ids FROM events")
def stream_tags(spark, sf_dir):
    """SS-05"""
    return to_end(stream.tagged(events_stream(spark, sf_dir), RULES).select("event_id", F.array_join("rule_ids", ",").alias("rule_ids")))


@query("stream_rule_index", ORACLES["rule_index_tags"])
def stream_rule_index(spark, sf_dir):
    """SS-05: 1,200 rules on a stream through the index of predicates"""
    tagged = to_end(stream.tagged(events_stream(spark, sf_dir), RuleIndex(spark, MANY_RULES)).filter(F.size("rule_ids") > 0))
    return tagged.select("event_id", F.size("rule_ids").cast("long").alias("n_rules"), F.array_min("rule_ids").alias("first_rule"), F.array_max("rule_ids").alias("last_rule"))


@query("stream_open_close", """
WITH o AS (SELECT user_id, ts, event_type, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM events WHERE event_type IN ('signup', 'error')),
s AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS start_ts, min(CASE WHEN event_type = 'error' THEN ts END) AS end_ts FROM o GROUP BY user_id, island)
SELECT user_id::VARCHAR AS key, start_ts, end_ts, 'closed' AS end_kind FROM s WHERE start_ts IS NOT NULL AND end_ts IS NOT NULL""")
def stream_open_close(spark, sf_dir):
    """SS-06: sessions that closed"""
    return arriving(spark, sf_dir, F.lit(0), 1)


@query("stream_open_close_late", ORACLES["stream_open_close"])
def stream_open_close_late(spark, sf_dir):
    """SS-06: the same from seven files in the order of arrival, where rows come up to two days late"""
    return arriving(spark, sf_dir, F.pmod(F.xxhash64("event_id"), F.lit(172_800)), 7)


FILE_ROWS = 500_000


def dealt(spark, sf_dir, delay_s, files):
    """A folder of the events, dealt into steps by the time they arrive, and how many files a step has. All steps have the
    same number, since a batch takes that many: a row of no kind lies in each file. Those of the last step are far in the
    future and let the watermark pass all others; one more step of them gives the batch in which rows are taken."""
    e = load(spark, sf_dir, "events").select("user_id", "ts", "event_type", (F.unix_timestamp("ts") + delay_s).alias("came"), F.xxhash64("event_id").alias("part"))
    lo, hi, first, last, rows = e.agg(F.min("came"), F.max("came"), F.min("ts"), F.max("ts"), F.count("came")).first()
    path, step, parts = fresh_path(spark), -(-(hi + 1 - lo) // files), 1 + rows // (files * FILE_ROWS)
    e = e.withColumn("part", F.pmod("part", F.lit(parts)))
    for n in range(files + 1):
        at = first if n < files - 1 else last + timedelta(days=30)
        fill = spark.range(parts).select(F.lit(None).cast("long").alias("user_id"), F.lit(at).alias("ts"), F.lit("none").alias("event_type"), F.col("id").alias("part"))
        some = e.filter(F.floor((F.col("came") - lo) / step) == n).drop("came").unionByName(fill) if n < files else fill
        some.repartitionById(parts, F.col("part").cast("int")).drop("part").write.mode("append").parquet(path)
    return path, parts


def arriving(spark, sf_dir, delay_s, files):
    """Closed sessions of the events, read step by step."""
    path, parts = dealt(spark, sf_dir, delay_s, files)
    kind = F.col("event_type")
    found = stream.open_close_sessions(read_files(spark, path, parts), "ts", "user_id", kind == "signup", kind == "error", late="3 days")
    return plain(to_end(found).filter("end_kind = 'closed'"))
