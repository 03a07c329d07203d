"""Whole correlation runs: named sources in, scored matches out (the two engines of the survey's section 3).

A run is one lazy plan. Sources are tables with an identity and a time column; a CorrelationSpec says how they are
lined up, filtered, scored and labelled. Match ids are hashes of what the match is, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions import predicates as P
from evspark.operators import correlate, ordered, rules
from evspark.operators.correlate import CorrelationSpec

LABELS = [(0.7, "High"), (0.4, "Medium"), (0.2, "Low")]


def unite(sources: dict[str, DataFrame], identity: Column, ts: str, keep: Sequence[str] = ()) -> DataFrame:
    """source, identity, ts and the kept columns of all sources."""
    parts = [df.select(F.lit(name).alias("source"), identity.cast("string").alias("identity"), F.col(ts).alias("ts"), *keep) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def filtered(rows: DataFrame, period: tuple | None = None, patterns: Sequence[str] = (), keep_null_ts: bool = False) -> DataFrame:
    """The period and the identity globs of a run."""
    if period:
        rows = rows.filter(P.in_period(F.col("ts"), *period, keep_null=keep_null_ts))
    return rows.filter(P.identity_glob([F.col("identity")], list(patterns))) if patterns else rows


def _scored(matches: DataFrame, spec: CorrelationSpec) -> DataFrame:
    """Sum of the weights of a match's sources (its array `sources`), label, interpretation, and a stable id."""
    weights = F.create_map(*[F.lit(x) for k in (spec.weights or {"": 0.0}).items() for x in k])
    score = F.bround(F.aggregate("sources", F.lit(0.0), lambda a, s: a + F.coalesce(F.element_at(weights, s), F.lit(0.0))), 2)
    m = matches.withColumn("score", score)
    return m.withColumn("label", correlate.label_of(F.col("score"), LABELS)).withColumn("level", correlate.interpret(F.col("score"))["level"])


def run_windows(sources: dict[str, DataFrame], spec: CorrelationSpec, identity: Column, ts: str, period: tuple | None = None, patterns: Sequence[str] = (), closed: str = "left") -> DataFrame:
    """Identities that several sources show in one scan window."""
    rows = filtered(unite(sources, identity, ts), period, patterns)
    step = spec.step_minutes * 60 if spec.step_minutes else None
    w = correlate.windows(rows, "ts", spec.window_minutes * 60, step, closed=closed)
    m = _scored(correlate.correlate_windows(w, "identity", "source", "ts", spec.min_sources), spec)
    return m.withColumn("match_id", F.sha2(F.concat_ws("|", F.unix_micros("window_start").cast("string"), "identity"), 256))


def run_identities(sources: dict[str, DataFrame], spec: CorrelationSpec, identity: Column, ts: str, period: tuple | None = None, patterns: Sequence[str] = ()) -> DataFrame:
    """Anchors of each identity: its rows in time order, cut where a gap is wider than the window; exact repeats count once."""
    rows = filtered(unite(sources, identity, ts), period, patterns, keep_null_ts=True).filter(F.col("identity").isNotNull())
    once = rows.dropDuplicates(["identity", "source", "ts"])
    a = ordered.gap_clusters(once, ["identity"], "ts", spec.window_minutes * 60, extra=[F.array_sort(F.collect_set("source")).alias("sources"), F.count_distinct("source").alias("n_sources")])
    m = _scored(a.filter(F.col("n_sources") >= spec.min_sources), spec)
    return m.withColumn("match_id", F.sha2(F.concat_ws("|", "identity", F.coalesce(F.unix_micros("start_ts").cast("string"), F.lit("none"))), 256))


def tag_matches(matches: DataFrame, found: Sequence[rules.Rule]) -> DataFrame:
    """Rules on the columns of matches."""
    return rules.tag_rows(matches, found)
