"""Queries: aggregations, set operations, joins to dictionaries, result queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.operators import aggs, bitmaps, joins, ordered, paging, search
from evspark.plans.registry import query
from evspark.plans.tables import events, load, plain
from evspark.storage import written


@query("bucket_counts", """
WITH k AS (SELECT epoch_us(ts) // 21600000000 * 21600000000 AS b, event_type AS k, count(*) AS n FROM events GROUP BY ALL)
SELECT make_timestamp(b) AS bucket_ts, sum(n)::BIGINT AS total, string_agg(k || '=' || n::VARCHAR, ',' ORDER BY k) AS kinds FROM k GROUP BY b""")
def bucket_counts(spark, sf_dir):
    """AG-01"""
    b = aggs.bucket_counts(events(spark, sf_dir), "ts", "source", "6hour")
    kinds = F.array_join(F.transform(F.map_entries("by_kind"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return plain(b.select("bucket_ts", "total", kinds.alias("kinds")))


@query("bucket_drilldown", "SELECT make_timestamp(epoch_us(ts) // 86400000000 * 86400000000) AS bucket_ts, event_id, user_id FROM events WHERE event_type = 'purchase'")
def bucket_drilldown(spark, sf_dir):
    """AG-03"""
    e = events(spark, sf_dir).filter("source = 'purchase'")
    return plain(aggs.expand_bucket(aggs.bucket_counts(e, "ts", "source", "day"), e, "ts", "day").select("bucket_ts", "event_id", "user_id"))


@query("hourly_heatmap", "SELECT event_type AS source, ts::DATE AS day, hour(ts)::INTEGER AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_heatmap(spark, sf_dir):
    """AG-04"""
    return aggs.heat(events(spark, sf_dir), "source", "ts", {"total": F.col("value")}).withColumn("total", F.round("total", 4))


@query("partial_heatmap", """
SELECT day, sum(n)::BIGINT AS n FROM (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT l_shipdate::DATE, count(*) FROM lineitem GROUP BY 1) GROUP BY day""")
def partial_heatmap(spark, sf_dir):
    """AG-05, ST-01"""
    a = load(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    b = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return aggs.resum([a, b], ["day"], ["n"])


@query("dense_calendar", """
WITH b AS (SELECT greatest(min(o_orderdate)::DATE, (max(o_orderdate)::DATE - INTERVAL 60 MONTH)::DATE) AS lo, max(o_orderdate)::DATE AS hi FROM orders),
d AS (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM b), s AS (SELECT DISTINCT o_orderstatus AS source FROM orders),
n AS (SELECT o_orderdate::DATE AS day, o_orderstatus AS source, count(*) AS n FROM orders GROUP BY ALL)
SELECT d.day, s.source, coalesce(n, 0) AS n FROM d CROSS JOIN s LEFT JOIN n ON n.day = d.day AND n.source = s.source""")
def dense_calendar(spark, sf_dir):
    """AG-39"""
    return aggs.dense_days(aggs.heat(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate")).select("day", "source", "n")


@query("time_bounds", "SELECT min(t) AS first_ts, max(t) AS last_ts FROM (SELECT o_orderdate AS t FROM orders UNION ALL SELECT l_shipdate FROM lineitem) WHERE t >= TIMESTAMP '2000-01-01'")
def time_bounds(spark, sf_dir):
    """AG-06, TS-13"""
    d = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "full")
    return plain(aggs.bounds(d, ["o_orderdate", "l_shipdate"]))


@query("outlier_range", """
WITH t AS (SELECT l_suppkey, epoch_us(l_shipdate) AS t, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n, max(epoch_us(l_shipdate)) OVER (PARTITION BY l_suppkey) AS latest FROM lineitem),
q AS (SELECT *, max(CASE WHEN i = n // 4 THEN t END) OVER w AS q1, max(CASE WHEN i = 3 * n // 4 THEN t END) OVER w AS q3 FROM t WINDOW w AS (PARTITION BY l_suppkey)),
o AS (SELECT *, n >= 4 AND (t < q1 - (q3 - q1) * 1.5 OR t > q3 + (q3 - q1) * 1.5 OR t < latest - 630720000000000) AS out_ FROM q)
SELECT l_suppkey, make_timestamp(min(CASE WHEN NOT out_ THEN t END)) AS first_ts, make_timestamp(max(CASE WHEN NOT out_ THEN t END)) AS last_ts, count(*) FILTER (out_) AS n_outliers FROM o GROUP BY l_suppkey""")
def outlier_range(spark, sf_dir):
    """AG-07"""
    return plain(aggs.robust_range(load(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_shipdate"))


@query("breakdowns", "SELECT event_type AS source, count(*) AS n FROM events GROUP BY 1")
def breakdowns(spark, sf_dir):
    """AG-09, AG-13, AG-19"""
    return aggs.breakdown(events(spark, sf_dir), "source")


@query("timeline_statistics", "SELECT min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS span_s, count(DISTINCT user_id) AS n_identities, count(*) AS n_rows FROM events")
def timeline_statistics(spark, sf_dir):
    """AG-10"""
    return plain(aggs.span_statistics(events(spark, sf_dir), "ts", "user_id"))


@query("anchor_time_stats", """
WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n_, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT o_orderdate, count(DISTINCT o_custkey) AS n_identities, coalesce(sum(n), 0)::BIGINT AS n_evidence, coalesce(sum(a), 0)::BIGINT AS n_a, coalesce(sum(n_), 0)::BIGINT AS n_n, coalesce(sum(r), 0)::BIGINT AS n_r FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderdate""")
def anchor_time_stats(spark, sf_dir):
    """AG-11"""
    e = load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return plain(aggs.role_statistics(load(spark, sf_dir, "orders"), e, "o_orderkey", ["o_orderdate"], "o_custkey", "l_returnflag", ["A", "N", "R"]))


@query("identity_top_values", """
WITH n AS (SELECT user_id, props, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, props)::INTEGER AS rank FROM n) SELECT * FROM r WHERE rank <= 10""")
def identity_top_values(spark, sf_dir):
    """AG-12: a report of ten values a user"""
    return aggs.top_per(events(spark, sf_dir), ["user_id"], "props", 10).select("user_id", "props", "n", "rank")


@query("run_statistics", "SELECT count(*) AS n_matches, count(DISTINCT o_orderstatus) AS n_runs, max(o_orderstatus) AS latest_run, min(o_orderdate) AS first_ts, max(o_orderdate) AS last_ts FROM orders")
def run_statistics(spark, sf_dir):
    """AG-14"""
    return plain(aggs.run_statistics(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", "o_orderdate")[0])


@query("top_applications", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 5")
def top_applications(spark, sf_dir):
    """AG-14, WN-17: a report of five"""
    return aggs.run_statistics(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_shipdate")[1]


@query("journal_statistics", "SELECT min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts, count(DISTINCT l_partkey) AS n_files, count(*) AS n_events FROM lineitem")
def journal_statistics(spark, sf_dir):
    """AG-15"""
    return plain(aggs.journal_statistics(load(spark, sf_dir, "lineitem"), "l_shipdate", "l_partkey"))


@query("correlation_statistics", "SELECT round(avg(l_discount), 9) AS avg_score, count(*) FILTER (l_discount >= 0.08) AS n_high, count(DISTINCT l_orderkey) AS n_records, count(DISTINCT l_partkey) AS n_events FROM lineitem")
def correlation_statistics(spark, sf_dir):
    """AG-16"""
    return aggs.correlation_statistics(load(spark, sf_dir, "lineitem"), "l_discount", "l_orderkey", "l_partkey", 0.08).withColumn("avg_score", F.round("avg_score", 9))


@query("having_multi", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def having_multi(spark, sf_dir):
    """AG-17"""
    return aggs.having_many(load(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("monthly", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def monthly(spark, sf_dir):
    """AG-17"""
    return aggs.monthly(load(spark, sf_dir, "orders"), "o_orderdate")


@query("ordered_changes", "SELECT o_custkey, string_agg(o_orderstatus || '@' || o_orderkey::VARCHAR, '; ' ORDER BY o_orderdate, o_orderkey, o_orderstatus || '@' || o_orderkey::VARCHAR) AS changes FROM orders GROUP BY 1")
def ordered_changes(spark, sf_dir):
    """AG-18"""
    return aggs.ordered_text(load(spark, sf_dir, "orders"), ["o_custkey"], F.concat_ws("@", "o_orderstatus", "o_orderkey"), ["o_orderdate", "o_orderkey"])


@query("identity_groups", "SELECT user_id, count(*) AS n_records, count(DISTINCT event_type) AS n_sources, min(ts) AS first_seen, max(ts) AS last_seen, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT event_type AS s FROM events i WHERE i.user_id = e.user_id)) AS sources FROM events e GROUP BY user_id")
def identity_groups(spark, sf_dir):
    """AG-20"""
    g = aggs.identity_groups(events(spark, sf_dir), ["user_id"], "source", "ts")
    return plain(g.withColumn("sources", F.array_join("sources", ",")))


@query("distinct_from_parts", """
WITH w AS (SELECT * FROM (VALUES ('first week', DATE '2024-01-01', DATE '2024-01-07'), ('odd stretch', DATE '2024-01-05', DATE '2024-01-21'), ('all', DATE '2000-01-01', DATE '2100-01-01')) t(range_name, lo, hi))
SELECT range_name, event_type AS source, count(*) AS n, count(DISTINCT props) AS n_identities, round(sum(value), 4) AS total FROM events JOIN w ON ts::DATE BETWEEN lo AND hi GROUP BY ALL""")
def distinct_from_parts(spark, sf_dir):
    """AG-05, AG-20, AG-26: rows, sums and distinct properties over ranges of days, from stored daily parts alone"""
    e = events(spark, sf_dir)
    e = e.join(bitmaps.numbered(e, "props"), "props", "left").withColumn("day", F.to_date("ts"))
    kept = written(bitmaps.parts(e, ["source", "day"], sums={"total": F.col("value")}))
    ranges = [("first week", "2024-01-01", "2024-01-07"), ("odd stretch", "2024-01-05", "2024-01-21"), ("all", "2000-01-01", "2100-01-01")]
    in_range = F.filter(F.array(*[F.when(F.col("day").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")), F.lit(name)) for name, lo, hi in ranges]), lambda x: x.isNotNull())
    hit = kept.withColumn("range_name", F.explode(in_range))
    return bitmaps.merged(hit, ["range_name", "source"], ["total"]).withColumn("total", F.round("total", 4))


@query("sub_identities", "WITH n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, sum(n)::BIGINT AS n_records, string_agg(p_type || '=' || n::VARCHAR, ',' ORDER BY p_type) AS subs FROM n GROUP BY 1")
def sub_identities(spark, sf_dir):
    """AG-20 with sub-identities"""
    p = load(spark, sf_dir, "part").withColumn("ts", F.lit(None).cast("timestamp"))
    g = aggs.identity_groups(p, ["p_brand"], "p_name", "ts", "p_type")
    return g.select("p_brand", "n_records", F.array_join(F.transform(F.map_entries("sub_identities"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("subs"))


@query("extraction_statistics", """
WITH d AS (SELECT source, lang, CASE WHEN lang = 'en' THEN 'too_common' END AS problem FROM documents)
SELECT source, count(*) AS total, count(*) FILTER (lang IS NOT NULL AND problem IS NULL) AS extracted, count(*) FILTER (lang IS NULL) AS failed, count(*) FILTER (lang IS NOT NULL AND problem IS NOT NULL) AS filtered, count(DISTINCT CASE WHEN problem IS NULL THEN lang END) AS n_identities FROM d GROUP BY source""")
def extraction_statistics(spark, sf_dir):
    """AG-21"""
    d = load(spark, sf_dir, "documents").select("source", "lang", F.when(F.col("lang") == "en", "too_common").alias("problem"))
    return aggs.extraction_statistics(d, "source", "lang", "problem").drop("top3")


@query("identity_registry", "SELECT props AS value, event_type AS kind, count(*) AS n_refs, count(DISTINCT user_id) AS n_matches FROM (SELECT DISTINCT props, event_type, user_id, event_id FROM events WHERE props IS NOT NULL) GROUP BY ALL")
def identity_registry(spark, sf_dir):
    """AG-22, AG-23"""
    return aggs.identity_registry(events(spark, sf_dir).select(F.col("props").alias("value"), F.col("source").alias("kind"), "user_id", "event_id"), "value", "kind", ["user_id", "event_id"])


@query("registry_statistics", "WITH r AS (SELECT props, event_type AS kind, count(*) AS n FROM events GROUP BY ALL) SELECT kind, count(*) AS n_identities, sum(n)::BIGINT AS n_refs, round(avg(n), 2) AS avg_refs FROM r GROUP BY 1")
def registry_statistics(spark, sf_dir):
    """AG-22"""
    return aggs.registry_statistics(identity_registry(spark, sf_dir), "kind")


@query("cross_source_identities", "SELECT user_id, count(DISTINCT event_type) AS n_sources FROM events WHERE value > 50 GROUP BY 1 HAVING count(DISTINCT event_type) >= 3")
def cross_source_identities(spark, sf_dir):
    """AG-25 over rows of high value, a predicate of the search: of all rows every identity is in all sources"""
    return aggs.cross_source(events(spark, sf_dir).filter("value > 50"), "user_id", "source", 3)


PERIODS = "p AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'first' ELSE 'second' END AS period FROM events)"


def halves(spark, sf_dir):
    return events(spark, sf_dir).withColumn("period", F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "first").otherwise("second"))


@query("period_compare", f"""
WITH {PERIODS}, b AS (SELECT period, count(*) AS n, count(DISTINCT user_id) AS n_identities, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE AS minutes FROM p GROUP BY 1),
k AS (SELECT period, event_type AS dominant FROM (SELECT period, event_type, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, event_type) AS rn FROM p GROUP BY period, event_type) WHERE rn = 1),
h AS (SELECT period, hr AS peak_hour FROM (SELECT period, date_trunc('hour', ts) AS hr, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, date_trunc('hour', ts)) AS rn FROM p GROUP BY period, date_trunc('hour', ts)) WHERE rn = 1)
SELECT period, n, n_identities, round(minutes, 6) AS minutes, round(n / minutes, 9) AS density, dominant, peak_hour FROM b JOIN k USING (period) JOIN h USING (period)""")
def period_compare(spark, sf_dir):
    """AG-27"""
    m = aggs.period_metrics(halves(spark, sf_dir), "period", "ts", "source", "user_id")
    return plain(m.withColumn("minutes", F.round("minutes", 6)).withColumn("density", F.round("density", 9)))


@query("period_trend", f"""
WITH {PERIODS}, c AS (SELECT event_type AS source, count(*) FILTER (period = 'first') AS before, count(*) FILTER (period = 'second') AS after FROM p GROUP BY 1)
SELECT *, CASE WHEN before = 0 THEN 'new' WHEN (after - before) * 100.0 / before > 20 THEN 'strong increase' WHEN (after - before) * 100.0 / before > 10 THEN 'increase' WHEN (after - before) * 100.0 / before < -20 THEN 'strong decrease' WHEN (after - before) * 100.0 / before < -10 THEN 'decrease' ELSE 'stable' END AS trend FROM c""")
def period_trend(spark, sf_dir):
    """AG-28"""
    c = halves(spark, sf_dir).groupBy("source").agg(F.count_if(F.col("period") == "first").alias("before"), F.count_if(F.col("period") == "second").alias("after"))
    return c.withColumn("trend", aggs.trend(F.col("before"), F.col("after")))


@query("set_overlap", f"""
WITH {PERIODS}, x AS (SELECT DISTINCT props FROM p WHERE period = 'first' AND value > 60), y AS (SELECT DISTINCT props FROM p WHERE period = 'second' AND value > 60),
j AS (SELECT x.props AS a, y.props AS b FROM x FULL JOIN y ON x.props = y.props)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS n_both, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, count(*) AS n_union, round(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) * 100.0::DOUBLE / greatest(count(*), 1), 2) AS percent FROM j""")
def set_overlap(spark, sf_dir):
    """ST-03 over rows of high value, a predicate of the search: of all rows both halves hold the same properties"""
    h = halves(spark, sf_dir).filter("value > 60")
    return aggs.set_overlap(h.filter("period = 'first'"), h.filter("period = 'second'"), "props")


@query("exact_time_groups", "SELECT o_orderdate, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def exact_time_groups(spark, sf_dir):
    """AG-29"""
    return plain(aggs.exact_time_groups(load(spark, sf_dir, "orders"), "o_orderdate"))


@query("groups_by_path", r"SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS group_key, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) > 1 AND regexp_extract(url, '^https?://([^/]+)', 1) IS NOT NULL")
def groups_by_path(spark, sf_dir):
    """AG-30"""
    return aggs.groups_of(load(spark, sf_dir, "pages"), F.regexp_extract("url", r"^https?://([^/]+)", 1))


@query("mode_share", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, round(max(n) / sum(n), 9) AS similarity FROM n GROUP BY 1")
def mode_share(spark, sf_dir):
    """AG-31"""
    return aggs.mode_share(events(spark, sf_dir), ["user_id"], "source").withColumn("similarity", F.round("similarity", 9))


@query("usage_top", "SELECT l_suppkey, round(sum(l_quantity), 2) AS total, min(l_shipdate) AS first_active, max(l_shipdate) AS last_active FROM lineitem GROUP BY 1 ORDER BY total DESC, l_suppkey LIMIT 10")
def usage_top(spark, sf_dir):
    """AG-32: a report of ten"""
    return plain(aggs.usage(load(spark, sf_dir, "lineitem"), "l_suppkey", "l_shipdate", {"total": F.round(F.col("l_quantity"), 2)}, 10))


@query("auth_counts", "SELECT count(*) FILTER (event_type = 'signup') AS logins, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type = 'signup' AND value > 90) AS remote FROM events")
def auth_counts(spark, sf_dir):
    """AG-33"""
    s = F.col("source")
    return aggs.count_kinds(events(spark, sf_dir), {"logins": s == "signup", "failures": s == "error", "remote": (s == "signup") & (F.col("value") > 90)})


@query("pivot_latest", """
WITH r AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS view, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'purchase' THEN value END) AS purchase FROM r WHERE rn = 1 GROUP BY 1""")
def pivot_latest(spark, sf_dir):
    """AG-34"""
    return aggs.pivot_latest(events(spark, sf_dir), ["user_id"], "source", "value", ["ts", "event_id"], ["view", "click", "purchase"])


@query("result_summary", "SELECT count(*) AS n, round(avg(value), 3) AS avg_score, round(avg(user_id), 3) AS avg_sources, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT event_type AS t FROM events)) AS apps FROM events")
def result_summary(spark, sf_dir):
    """AG-35, AG-41"""
    return aggs.summary(events(spark, sf_dir), "value", "user_id", "source").withColumn("apps", F.array_join("apps", ","))


@query("both_ends", """
(SELECT event_id, ts, 'head' AS part FROM events ORDER BY ts, event_id LIMIT 10) UNION ALL (SELECT event_id, ts, 'tail' FROM events ORDER BY ts DESC, event_id DESC LIMIT 10)""")
def both_ends(spark, sf_dir):
    """AG-38: first and last ten: the limit is the feature"""
    return plain(aggs.both_ends(events(spark, sf_dir).select("event_id", "ts"), ["ts", "event_id"], 10))


@query("union_distinct", "SELECT o_orderpriority AS name FROM orders UNION SELECT c_mktsegment FROM customer")
def union_distinct(spark, sf_dir):
    """ST-02"""
    return aggs.union_distinct([load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")), load(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"))])


@query("insert_or_ignore", """
WITH k AS (SELECT CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_suppkey END AS s, l_returnflag AS f FROM lineitem)
SELECT s, f, count(*) AS n FROM (SELECT DISTINCT s, f FROM k WHERE s IS NOT NULL UNION ALL SELECT s, f FROM k WHERE s IS NULL) GROUP BY ALL""")
def insert_or_ignore(spark, sf_dir):
    """ST-04"""
    k = load(spark, sf_dir, "lineitem").select(F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("s"), F.col("l_returnflag").alias("f"))
    return joins.insert_or_ignore(k, ["s", "f"]).groupBy("s", "f").agg(F.count(F.lit(1)).alias("n"))


# joins


@query("identity_equi_join", """
SELECT v.user_id, count(*) AS n, round(max(v.value - p.value), 6) AS gap FROM events v JOIN events p ON v.user_id = p.user_id WHERE v.event_type = 'view' AND p.event_type = 'purchase' AND v.value > p.value GROUP BY 1""")
def identity_equi_join(spark, sf_dir):
    """JN-05"""
    e = events(spark, sf_dir).select("user_id", "source", "value")
    j = joins.cross_source_join({"v": e.filter("source = 'view'").drop("source"), "p": e.filter("source = 'purchase'").drop("source")}, "user_id", F.col("v_value") > F.col("p_value"))
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.col("v_value") - F.col("p_value")), 6).alias("gap"))


@query("identities_with_evidence", "SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def identities_with_evidence(spark, sf_dir):
    """JN-06"""
    o = load(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.with_any(load(spark, sf_dir, "customer"), o, "c_custkey").select("c_custkey", "c_mktsegment")


@query("interval_overlap", """
WITH o AS (SELECT o_orderkey, min(o_orderdate) AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING min(o_orderdate) <= max(l_shipdate)),
m AS (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS ms FROM orders)
SELECT ms AS month_start, count(*) AS n FROM o JOIN m ON s <= ms + INTERVAL 20 DAY AND e >= ms GROUP BY 1""")
def interval_overlap(spark, sf_dir):
    """JN-07: orders' life against the first twenty days of months"""
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.min("o_orderdate").alias("s"), F.max("l_shipdate").alias("e"))
    o = o.filter("s <= e")
    m = load(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("month_start")).distinct().withColumn("month_end", F.expr("month_start + interval 20 day"))
    return plain(joins.interval_join(o, m, "s", "e", "month_start", "month_end", 30 * 86_400).groupBy("month_start").agg(F.count(F.lit(1)).alias("n")))


@query("evidence_at_time", """
WITH a AS (SELECT o_orderkey, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT l_orderkey AS o_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN a ON l_orderkey = o_orderkey WHERE s <= TIMESTAMP '1998-06-15' AND e >= TIMESTAMP '1998-06-15'""")
def evidence_at_time(spark, sf_dir):
    """JN-08"""
    e = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate")
    a = e.join(load(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").groupBy("o_orderkey").agg(F.min("l_shipdate").alias("start_ts"), F.max("l_shipdate").alias("end_ts"))
    from datetime import datetime, timezone

    return plain(joins.evidence_at(a, e, "o_orderkey", datetime(1998, 6, 15, tzinfo=timezone.utc)))


@query("evidence_split", """
SELECT l_orderkey % 7 AS grp, count(*) FILTER (o_orderkey IS NOT NULL) AS anchored, count(*) FILTER (o_orderkey IS NULL) AS supporting FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey GROUP BY 1""")
def evidence_split(spark, sf_dir):
    """JN-09"""
    e = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    a = load(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    with_, without = joins.split_evidence(e, a, "k")
    both = with_.withColumn("a", F.lit(True)).unionByName(without.withColumn("a", F.lit(False)))
    return both.groupBy((F.col("k") % 7).alias("grp")).agg(F.count_if("a").alias("anchored"), F.count_if(~F.col("a")).alias("supporting"))


@query("matches_per_source", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def matches_per_source(spark, sf_dir):
    """JN-10, AG-37"""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.count_per(load(spark, sf_dir, "customer").select("c_custkey"), o, "c_custkey", "o_orderkey")


def run_tables(spark, sf_dir):
    m = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("result_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("match_id"), F.col("l_shipdate").alias("match_ts"), F.col("l_discount").alias("score"), F.col("l_returnflag").alias("app"))
    r = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("result_id"), F.col("o_custkey").alias("execution_id"), "o_orderpriority")
    x = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("execution_id"), F.col("c_mktsegment").alias("engine"))
    return m, r, x


@query("run_correlations", """
SELECT l_orderkey * 10 + l_linenumber AS match_id, l_shipdate AS match_ts, l_discount AS score, o_custkey AS execution_id, c_mktsegment AS engine FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31' AND l_returnflag = 'A' ORDER BY l_shipdate, l_discount DESC, l_orderkey * 10 + l_linenumber LIMIT 500""")
def run_correlations(spark, sf_dir):
    """JN-11, JN-12: a report of 500 matches"""
    m, r, x = run_tables(spark, sf_dir)
    keep = F.col("match_ts").between(F.lit("1998-01-01").cast("timestamp"), F.lit("1998-01-31").cast("timestamp")) & (F.col("app") == "A")
    return plain(joins.correlations_of_runs(m, r, x, keep).select("match_id", "match_ts", "score", "execution_id", "engine"))


@query("record_names", """
WITH r AS (SELECT p_partkey, p_brand FROM part), n AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber DESC, ('supp' || l_suppkey::VARCHAR)) AS rn FROM lineitem WHERE l_suppkey % 10 <> 0)
SELECT p_partkey AS record_number, 'supp' || n.l_suppkey::VARCHAR AS file_name, p_brand FROM r LEFT JOIN n ON l_partkey = p_partkey AND rn = 1""")
def record_names(spark, sf_dir):
    """JN-13: suppliers as names, line numbers as namespaces, every tenth a stream"""
    names = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("record_number"), F.concat(F.when(F.col("l_suppkey") % 10 == 0, ":").otherwise(""), F.lit("supp"), F.col("l_suppkey").cast("string")).alias("file_name"), F.col("l_linenumber").alias("namespace"))
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_number"), "p_brand")
    return joins.records_with_names(p.select("record_number"), names, p).select("record_number", "file_name", "p_brand")


@query("record_journal", """
SELECT p_partkey, l_orderkey, l_linenumber, CASE WHEN l_partkey IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS confidence FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_partkey <> 0""")
def record_journal(spark, sf_dir):
    """JN-14, STR-25: references carry a sequence number above bit 48"""
    j = load(spark, sf_dir, "lineitem").select((F.col("l_partkey") + F.lit(3 << 48)).alias("frn"), "l_orderkey", "l_linenumber")
    return joins.records_with_journal(load(spark, sf_dir, "part").select("p_partkey"), j, "p_partkey").select("p_partkey", "l_orderkey", "l_linenumber", "confidence")


NATIONS = "(SELECT n_nationkey::VARCHAR AS value, n_name AS key, 'nation' AS source FROM nation)"


@query("left_enrich", f"SELECT c_custkey, c_nationkey, d.key AS c_nationkey_key, coalesce(c_nationkey::VARCHAR || ' [' || d.key || ']', c_nationkey::VARCHAR) AS shown FROM customer LEFT JOIN {NATIONS} d ON d.value = c_nationkey::VARCHAR")
def left_enrich(spark, sf_dir):
    """JN-15, JN-16"""
    d = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("value"), F.col("n_name").alias("key"), F.lit("nation").alias("source"))
    return joins.enrich(load(spark, sf_dir, "customer"), d, "c_nationkey", "customer", "shown").select("c_custkey", "c_nationkey", "c_nationkey_key", "shown")


@query("parent_paths", """
WITH RECURSIVE n AS (SELECT doc_id AS id, CASE WHEN doc_id > 5 THEN CASE WHEN doc_id % 97 = 0 THEN -doc_id ELSE doc_id // 2 END WHEN doc_id = 5 THEN 5 ELSE 5 END AS up, 'd' || doc_id::VARCHAR AS name FROM documents),
r AS (SELECT id, '.' AS path FROM n WHERE id = 5
  UNION ALL SELECT id, '[Unknown Parent: ' || up::VARCHAR || ']/' || name FROM n WHERE up NOT IN (SELECT id FROM n)
  UNION ALL SELECT n.id, r.path || '/' || n.name FROM r JOIN n ON n.up = r.id AND n.id <> 5)
SELECT id, path FROM r""")
def parent_paths(spark, sf_dir):
    """JN-17: a document's parent is half its number, some parents are missing"""
    i = F.col("id")
    up = F.when(i > 5, F.when(i % 97 == 0, -i).otherwise(F.floor(i / 2))).otherwise(5)
    n = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).select("id", up.cast("long").alias("parent_id"), F.concat(F.lit("d"), i.cast("string")).alias("name"))
    return joins.parent_paths(n, root=5)


PLAIN = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda t: t <> '')"


@query("field_lookup", f"""
WITH w AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) WHEN 2 THEN replace(lower(p_type), ' ', '_') WHEN 3 THEN regexp_extract(p_type, '([A-Z]+) ([A-Z]+)', 2) || '-' || regexp_extract(p_type, '^[A-Z]+') || ' x' ELSE p_brand END AS name FROM part),
f AS (SELECT DISTINCT p_type AS field FROM part), a AS (SELECT p_brand AS name, min(p_type) AS alias FROM part GROUP BY 1),
c AS (SELECT name, field, CASE WHEN name = field THEN 1 WHEN lower(name) = lower(field) THEN 2 WHEN {PLAIN.format('name')} = {PLAIN.format('field')} THEN 3 WHEN alias IS NOT NULL AND {PLAIN.format('alias')} = {PLAIN.format('field')} THEN 4
    WHEN 2 * len(list_intersect(list_distinct({TOKENS.format('name')}), list_distinct({TOKENS.format('field')}))) >= greatest(len({TOKENS.format('name')}), len({TOKENS.format('field')})) THEN 5 END::INTEGER AS rank
  FROM w LEFT JOIN a USING (name), f)
SELECT name, field, rank FROM c WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, field) = 1""")
def field_lookup(spark, sf_dir):
    """JN-19: written variants of part types, and brands by their alias, looked up among the types"""
    p, t, n = load(spark, sf_dir, "part"), F.col("p_type"), F.col("p_partkey") % 5
    swapped = F.concat(F.regexp_extract(t, "([A-Z]+) ([A-Z]+)", 2), F.lit("-"), F.regexp_extract(t, "^[A-Z]+", 0), F.lit(" x"))
    name = F.when(n == 0, t).when(n == 1, F.lower(t)).when(n == 2, F.replace(F.lower(t), F.lit(" "), F.lit("_"))).when(n == 3, swapped).otherwise(F.col("p_brand"))
    aliases = p.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_type").alias("alias"))
    return joins.find_fields(p.select(name.alias("name")).distinct(), p.select(t.alias("field")).distinct(), aliases)


@query("propagated", """
WITH e AS (SELECT o_orderkey AS match_id, o_orderstatus AS source, o_custkey % 3 AS idx FROM orders),
p AS (SELECT l_orderkey AS match_id, l_linestatus AS source, l_linenumber % 3 AS idx, max(l_returnflag) AS semantic FROM lineitem GROUP BY ALL),
l AS (SELECT match_id, source, arg_min(semantic, idx) AS loose FROM p GROUP BY ALL)
SELECT e.match_id, e.source, e.idx, coalesce(p.semantic, l.loose) AS semantic FROM e LEFT JOIN p USING (match_id, source, idx) LEFT JOIN l USING (match_id, source)""")
def propagated(spark, sf_dir):
    """JN-20"""
    m = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_orderstatus").alias("source"), (F.col("o_custkey") % 3).alias("idx"))
    p = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("match_id"), F.col("l_linestatus").alias("source"), (F.col("l_linenumber") % 3).cast("long").alias("idx")).agg(F.max("l_returnflag").alias("semantic"))
    return joins.propagate(m, p).select("match_id", "source", "idx", "semantic")


# result queries


@query("page_fetch", "SELECT p_partkey, p_name, p_brand FROM part ORDER BY p_name, p_partkey LIMIT 25 OFFSET 50")
def page_fetch(spark, sf_dir):
    """SRC-03, QRY-02: the third page of 25"""
    return search.page(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_partkey"], 3, 25)


@query("deep_page", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber LIMIT 100 OFFSET (SELECT (count(*) // 100 - 1) * 100 FROM lineitem)")
def deep_page(spark, sf_dir):
    """SRC-03, QRY-02: the last full page of the lines by latest shipping; only the ranges it lies in are sorted"""
    order = [F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber"]
    stored = paging.Pages.store(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), order, ranges=32)
    return plain(stored.page(stored.total // 100, 100))


@query("page_facts", "SELECT count(*) AS total_count, ceil(count(*) / 25.0)::BIGINT AS total_pages, ceil(count(*) / 25.0) > 3 AS has_next, true AS has_prev FROM part")
def page_facts(spark, sf_dir):
    """SRC-03"""
    return search.page_facts(load(spark, sf_dir, "part"), 3, 25)


@query("identity_query", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name ILIKE '%0001%'")
def identity_query(spark, sf_dir):
    """QRY-02"""
    return search.identities(load(spark, sf_dir, "customer"), "BUILDING", "*0001*", "c_mktsegment", "c_name", "c_custkey").select("c_custkey", "c_name", "c_mktsegment")


@query("matches_by_score", "SELECT event_id, value AS score, event_type AS app FROM events WHERE value >= 20 AND lower(event_type) = 'click'")
def matches_by_score(spark, sf_dir):
    """QRY-01"""
    return search.matches_by(events(spark, sf_dir).select("event_id", F.col("value").alias("score"), F.col("source").alias("app")), score=20, app="Click")


@query("anchor_times_in_range", "SELECT DISTINCT o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'")
def anchor_times_in_range(spark, sf_dir):
    """QRY-04"""
    from datetime import datetime, timezone

    day = lambda *d: datetime(*d, tzinfo=timezone.utc)
    return plain(search.anchor_times(load(spark, sf_dir, "orders"), "o_orderdate", day(1997, 1, 1), day(1997, 3, 31)))


@query("run_history", "SELECT o_orderkey AS execution_id, o_orderdate AS run_ts, o_orderstatus AS engine, o_orderpriority AS pipeline_name FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority ILIKE '%urgent%'")
def run_history(spark, sf_dir):
    """QRY-05, QRY-07"""
    x = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("execution_id"), F.col("o_orderdate").alias("run_ts"), F.col("o_orderstatus").alias("engine"), F.col("o_orderpriority").alias("pipeline_name"))
    return plain(search.executions(x, engine="F", name="urgent"))


@query("groups_by_activity", """
SELECT o_orderdate AS group_start, count(*) AS n_evidence FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1""")
def groups_by_activity(spark, sf_dir):
    """QRY-06"""
    from datetime import datetime, timezone

    g = load(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").alias("group_start")).agg(F.count(F.lit(1)).alias("n_evidence"))
    return plain(search.groups_by(g, "activity", datetime(1998, 1, 1, tzinfo=timezone.utc), datetime(1998, 12, 31, tzinfo=timezone.utc)))


@query("matches_of_result", "SELECT l_orderkey * 10 + l_linenumber AS match_id, l_shipdate AS match_ts FROM lineitem WHERE l_orderkey = 7")
def matches_of_result(spark, sf_dir):
    """QRY-07"""
    return plain(search.matches_of(run_tables(spark, sf_dir)[0], result_id=7).select("match_id", "match_ts"))


@query("first_fit_anchors", """
WITH f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type, user_id ORDER BY ts) > 7200000000 THEN 1 ELSE 0 END AS n_ FROM events),
i AS (SELECT *, sum(n_) OVER (PARTITION BY event_type, user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM f)
SELECT event_type AS source, user_id, island, count(*) AS n FROM i GROUP BY ALL""")
def first_fit_anchors(spark, sf_dir):
    """WN-08"""
    return ordered.first_fit(events(spark, sf_dir), ["source", "user_id"], "ts", 7200).groupBy("source", "user_id", F.col("island").cast("long").alias("island")).agg(F.count(F.lit(1)).alias("n"))
