"""Queries: whole runs over the events, each type a source."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from evspark.operators import rules
from evspark.operators.correlate import CorrelationSpec
from evspark.plans import runs
from evspark.plans.registry import query
from evspark.plans.tables import events, plain

SPEC = CorrelationSpec(window_minutes=180, min_sources=2, weights={"purchase": 0.4, "signup": 0.3, "error": 0.2, "click": 0.1})
W = "CASE s WHEN 'purchase' THEN 0.4 WHEN 'signup' THEN 0.3 WHEN 'error' THEN 0.2 WHEN 'click' THEN 0.1 ELSE 0.0 END::DOUBLE"
LABEL = "CASE WHEN score >= 0.7 THEN 'High' WHEN score >= 0.4 THEN 'Medium' WHEN score >= 0.2 THEN 'Low' ELSE 'Unknown' END"
LEVEL = "CASE WHEN score >= 0.9 THEN 'Critical' WHEN score >= 0.7 THEN 'High' WHEN score >= 0.5 THEN 'Medium' WHEN score >= 0.3 THEN 'Low' ELSE 'Minimal' END"


def sources(spark, sf_dir):
    e = events(spark, sf_dir)
    return {s: e.filter(F.col("source") == s) for s in ("view", "click", "purchase", "signup", "error")}


@query("run_windows", f"""
WITH d AS (SELECT DISTINCT epoch_us(ts) // 10800000000 AS k, user_id::VARCHAR AS identity, event_type AS s, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' AND user_id::VARCHAR LIKE '1%'),
u AS (SELECT k, identity, s, count(*) AS n, min(ts) AS a, max(ts) AS b FROM d GROUP BY ALL),
g AS (SELECT k, identity, count(*) AS n_sources, sum(n)::BIGINT AS n_records, round(sum({W}), 2) AS score, string_agg(s, ',' ORDER BY s) AS sources FROM u GROUP BY ALL HAVING count(*) >= 2)
SELECT sha256((k * 10800000000)::VARCHAR || '|' || identity) AS match_id, make_timestamp(k * 10800000000) AS window_start, identity, n_sources, n_records, sources, score, {LABEL} AS label, {LEVEL} AS level FROM g""")
def run_windows(spark, sf_dir):
    """The window engine end to end: period and identity filter, windows, groups, scores, labels"""
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    m = runs.run_windows(sources(spark, sf_dir), SPEC, F.col("user_id"), "ts", (day(3), day(25)), ["1*"])
    return plain(m.select("match_id", "window_start", "identity", "n_sources", "n_records", F.array_join("sources", ",").alias("sources"), "score", "label", "level"))


@query("run_identities", f"""
WITH d AS (SELECT DISTINCT user_id::VARCHAR AS identity, event_type AS s, ts FROM events),
f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY identity ORDER BY ts) > 10800000000 THEN 1 ELSE 0 END AS n_ FROM d),
i AS (SELECT *, sum(n_) OVER (PARTITION BY identity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM f),
u AS (SELECT identity, island, s, count(*) AS n, min(ts) AS a, max(ts) AS b FROM i GROUP BY ALL),
g AS (SELECT identity, island, min(a) AS start_ts, max(b) AS end_ts, sum(n)::BIGINT AS n, count(*) AS n_sources, round(sum({W}), 2) AS score FROM u GROUP BY ALL HAVING count(*) >= 2)
SELECT sha256(identity || '|' || epoch_us(start_ts)::VARCHAR) AS match_id, identity, start_ts, end_ts, n, n_sources, score, {LABEL} AS label, CASE WHEN n_sources >= 4 OR score >= 0.9 THEN 'wide' ELSE '' END AS rule_ids FROM g""")
def run_identities(spark, sf_dir):
    """The identity engine end to end: anchors by gap, repeats out, scores, rule tags"""
    m = runs.run_identities(sources(spark, sf_dir), SPEC, F.col("user_id"), "ts")
    wide = rules.rules_of([{"rule_id": "wide", "label": "Many sources", "logic": "OR", "conditions": [{"field": "n_sources", "operator": ">=", "value": 4}, {"field": "score", "operator": ">=", "value": 0.9}]}])
    m = runs.tag_matches(m, wide)
    return plain(m.select("match_id", "identity", "start_ts", "end_ts", "n", "n_sources", "score", "label", F.array_join("rule_ids", ",").alias("rule_ids")))
