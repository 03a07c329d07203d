"""Queries: reports over periods and files, result search, risks, default and stored dictionaries, stored streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.functions import textfn as X
from evspark.operators import aggs, correlate, ordered, rules, search, timeline
from evspark.plans.q_aggs import PERIODS, halves
from evspark.plans.q_correlate import ISLANDS
from evspark.plans.q_stream import events_stream
from evspark.plans.registry import query
from evspark.plans.tables import events, load, plain
from evspark.sources import io
from evspark.sources.store import ResultStore
from evspark.storage import fresh_path


@query("sql_durations", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 5) * 3600 + (event_id % 7) * 60 + event_id % 11 WHEN 1 THEN (event_id % 13) * 60 WHEN 2 THEN (event_id % 900) / 1000.0 ELSE (event_id % 1000) * 1024 END::DOUBLE AS n FROM events""")
def sql_durations(spark, sf_dir):
    """UD-02: durations and sizes in SQL"""
    X.register(spark)
    events(spark, sf_dir).createOrReplaceTempView("evspark_events")
    return spark.sql("""SELECT event_id, parsable_num(CASE event_id % 4 WHEN 0 THEN concat(event_id % 5, 'h ', event_id % 7, 'm ', event_id % 11, 's') WHEN 1 THEN concat(event_id % 13, ' min')
      WHEN 2 THEN concat(event_id % 900, ' ms') ELSE concat(event_id % 1000, ' KB') END) AS n FROM evspark_events""").select("event_id", F.round("n", 3).alias("n"))


def said(column):
    """A map as text, for comparison."""
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string"))), ",")


@query("period_report", f"""
WITH {PERIODS}, q AS (SELECT *, date_trunc('hour', ts) AS hr, CASE WHEN value > 50 THEN 'large' ELSE 'small' END AS role FROM p),
b AS (SELECT period, count(*) AS total_evidence, count(DISTINCT user_id) AS unique_identities, count(*) / greatest((epoch_us(max(hr)) - epoch_us(min(hr))) / 60000000.0::DOUBLE, 1.0) AS activity_density FROM q GROUP BY 1),
r AS (SELECT period, string_agg(role || '=' || n, ',' ORDER BY role) AS by_role FROM (SELECT period, role, count(*) AS n FROM q GROUP BY ALL) GROUP BY 1),
a AS (SELECT period, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS by_kind, string_agg(event_type, ',' ORDER BY n DESC, event_type) FILTER (rn <= 3) AS top3 FROM (SELECT period, event_type, count(*) AS n, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, event_type) AS rn FROM q GROUP BY period, event_type) GROUP BY 1),
h AS (SELECT period, hr AS peak_ts FROM (SELECT period, hr, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, hr) AS rn FROM q GROUP BY period, hr) WHERE rn = 1),
d AS (SELECT period, role AS dominant FROM (SELECT period, role, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, role) AS rn FROM q GROUP BY period, role) WHERE rn = 1)
SELECT period, total_evidence, unique_identities, round(activity_density, 9) AS activity_density, by_role, by_kind, top3, peak_ts, dominant FROM b JOIN r USING (period) JOIN a USING (period) JOIN h USING (period) JOIN d USING (period)""")
def period_report(spark, sf_dir):
    """AG-27 with breakdowns and the top 3"""
    e = halves(spark, sf_dir).withColumn("hr", F.date_trunc("hour", "ts")).withColumn("role", F.when(F.col("value") > 50, "large").otherwise("small"))
    r = aggs.period_report(e, "period", "hr", "user_id", {"by_role": "role", "by_kind": "source"}, "source", "role")
    return plain(r.withColumns({"activity_density": F.round("activity_density", 9), "by_role": said("by_role"), "by_kind": said("by_kind"), "top3": F.array_join("top3", ",")}))


@query("trend_report", f"""
WITH {PERIODS}, c AS (SELECT count(*) FILTER (period = 'second') AS n, count(*) FILTER (period = 'first') AS w, count(DISTINCT user_id) FILTER (period = 'second') AS ni, count(DISTINCT user_id) FILTER (period = 'first') AS wi,
  (epoch_us(max(ts) FILTER (period = 'second')) - epoch_us(min(ts) FILTER (period = 'second'))) / 60000000.0::DOUBLE AS ns, (epoch_us(max(ts) FILTER (period = 'first')) - epoch_us(min(ts) FILTER (period = 'first'))) / 60000000.0::DOUBLE AS ws FROM p),
o AS (SELECT count(*) FILTER (a AND b) * 100.0 / count(*) AS overlap FROM (SELECT user_id, bool_or(period = 'first') AS a, bool_or(period = 'second') AS b FROM p GROUP BY 1)),
k AS (SELECT count(*) AS kinds FROM (SELECT event_type FROM p GROUP BY 1 HAVING count(DISTINCT period) = 2)),
f AS (SELECT *, (n - w) * 100.0 / w AS act, (ni - wi) * 100.0 / wi AS gr, n / greatest(ns, 1.0) AS nd, w / greatest(ws, 1.0) AS wd FROM c, o, k)
SELECT round(act, 6) AS activity_percent, CASE WHEN act > 20 THEN 'up' WHEN act < -20 THEN 'down' ELSE 'Stable' END AS activity_change, round(gr, 6) AS growth_percent, CASE WHEN gr > 10 THEN 'up' WHEN gr < -10 THEN 'down' ELSE 'Stable' END AS identity_growth,
  CASE WHEN nd > wd * 1.5 THEN 'Intensifying activity' WHEN nd < wd * 0.5 THEN 'Declining activity' ELSE 'Consistent activity' END AS pattern, round(nd / greatest(wd, 0.1), 9) AS density_ratio, round(overlap, 6) AS overlap_percent,
  coalesce(nullif(concat_ws(',', CASE WHEN n > w * 2 THEN 'activity_spike' WHEN n < w * 0.5 THEN 'activity_drop' END, CASE WHEN overlap < 20 THEN 'low_overlap' WHEN overlap > 80 THEN 'high_overlap' END, CASE WHEN kinds < 3 THEN 'few_common_kinds' END, CASE WHEN nd > wd * 3 THEN 'density_spike' END), ''), 'normal') AS advice FROM f""")
def trend_report(spark, sf_dir):
    """AG-28 with bands, pattern and advice; the bands' direction is compared, their text in pytest"""
    r = aggs.trend_report(halves(spark, sf_dir), "period", "second", "first", "ts", "user_id", "source")
    way = lambda c: F.when(F.col(c).startswith("Increased"), "up").when(F.col(c).startswith("Decreased"), "down").otherwise(F.col(c))
    numbers = {c: F.round(c, d) for c, d in (("activity_percent", 6), ("growth_percent", 6), ("density_ratio", 9), ("overlap_percent", 6))}
    return r.withColumns({**numbers, "activity_change": way("activity_change"), "identity_growth": way("identity_growth"), "advice": F.array_join("advice", ",")})


@query("file_report", """
WITH f AS (SELECT o_custkey AS record, o_orderpriority AS name, CASE WHEN o_orderkey % 7 = 0 THEN '[Unknown Parent: 1]/' || o_orderpriority ELSE './' || o_orderstatus END AS path, o_orderstatus = 'P' AS deleted FROM orders),
c AS (SELECT o_custkey AS record, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS ts FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT o_custkey AS record, o_orderpriority AS name, o_orderstatus AS namespace FROM orders WHERE o_orderkey % 3 > 0),
s AS (SELECT record, count(DISTINCT name) AS k FROM n GROUP BY 1 HAVING count(DISTINCT name) > 1)
SELECT 'rows' AS section, 1 AS rank, NULL AS item, count(*) AS n FROM f UNION ALL SELECT 'records', 1, NULL, count(DISTINCT record) FROM f UNION ALL SELECT 'deleted', 1, NULL, count(*) FILTER (deleted) FROM f
UNION ALL SELECT 'unknown_parent', 1, NULL, count(*) FILTER (path LIKE '%[Unknown Parent%') FROM f UNION ALL SELECT 'renames', 1, NULL, count(*) FROM c UNION ALL SELECT 'several_names', 1, NULL, count(*) FROM s
UNION ALL SELECT 'most_modified', rn, item, n FROM (SELECT name || '|' || path AS item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, name || '|' || path) AS rn FROM f GROUP BY 1) WHERE rn <= 10
UNION ALL SELECT 'most_renamed', rn, item, n FROM (SELECT record::VARCHAR AS item, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, record::VARCHAR) AS rn FROM c GROUP BY 1) WHERE rn <= 5
UNION ALL SELECT 'most_names', rn, record::VARCHAR, k FROM (SELECT *, row_number() OVER (ORDER BY k DESC, record) AS rn FROM s) WHERE rn <= 10
UNION ALL SELECT 'namespace', 1, namespace, count(*) FROM n WHERE record IN (SELECT record FROM s) GROUP BY namespace
UNION ALL SELECT 'month', rn, item, n FROM (SELECT strftime(ts, '%Y-%m') AS item, count(*) AS n, row_number() OVER (ORDER BY strftime(ts, '%Y-%m') DESC) AS rn FROM c WHERE ts IS NOT NULL GROUP BY 1) WHERE rn <= 12""")
def file_report(spark, sf_dir):
    """AG-17, all parts: orders as file rows of customers"""
    o, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.when(key % 7 == 0, F.concat(F.lit("[Unknown Parent: 1]/"), "o_orderpriority")).otherwise(F.concat(F.lit("./"), "o_orderstatus"))
    record = F.col("o_custkey").alias("record")
    files = o.select(record, F.col("o_orderpriority").alias("name"), path.alias("path"), (F.col("o_orderstatus") == "P").alias("deleted"))
    changes = o.filter("o_orderstatus = 'F'").select(record, F.when(key % 5 > 0, F.col("o_orderdate")).alias("ts"))
    names = o.filter(key % 3 > 0).select(record, F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("namespace"))
    return aggs.file_report(files, changes, names)


@query("export_summary", """
SELECT (SELECT count(*) FROM orders) AS total_matches, (SELECT round(avg(o_totalprice / 500000), 3) FROM orders) AS average_score, count(*) AS total_tabs, count(*) FILTER (c_acctbal > 0) AS tabs_with_semantics, count(*) FILTER (c_nationkey % 3 = 0) AS tabs_with_scoring,
  round(count(*) FILTER (c_acctbal > 0) * 100.0::DOUBLE / count(*), 1) AS semantic_percent, round(count(*) FILTER (c_nationkey % 3 = 0) * 100.0::DOUBLE / count(*), 1) AS scoring_percent FROM customer""")
def export_summary(spark, sf_dir):
    """AG-35 with coverage percents: customers as tabs, orders as matches"""
    tabs = load(spark, sf_dir, "customer").select((F.col("c_acctbal") > 0).alias("semantic"), (F.col("c_nationkey") % 3 == 0).alias("scoring"))
    return aggs.export_summary(load(spark, sf_dir, "orders").select((F.col("o_totalprice") / 500_000).alias("score")), tabs, "score", "semantic", "scoring")


@query("empty_windows", """
WITH w AS (SELECT epoch_us(ts) // 3600000000 AS k, user_id FROM events WHERE event_type = 'purchase' GROUP BY ALL), b AS (SELECT min(k) AS lo, max(k) AS hi FROM w)
SELECT make_timestamp(k * 3600000000) AS window_start FROM (SELECT unnest(range(lo, hi + 1)) AS k FROM b) WHERE k NOT IN (SELECT k FROM w)""")
def empty_windows(spark, sf_dir):
    """CW-05: windows by status"""
    e = events(spark, sf_dir).filter("source = 'purchase'").select(F.date_trunc("hour", "ts").alias("window_start"), "user_id").distinct()
    return plain(correlate.window_states(e, "window_start", 3600, "empty").select("window_start"))


@query("temporal_search", "SELECT event_id AS id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS match_text, least(value / 100, 1)::DOUBLE AS confidence FROM events WHERE (strftime(ts, '%Y-%m-%d %H:%M:%S') LIKE '%2024-01-05%' OR strftime(ts, '%Y-%m-%d %H:%M:%S') LIKE '%13:4%') AND strftime(ts, '%Y-%m-%d %H:%M:%S') SIMILAR TO '.*(2024-01-05|13:45).*' AND value >= 20")
def temporal_search(spark, sf_dir):
    """SR-07: a query that names a day and a time, surest first"""
    r = search.find_results(events(spark, sf_dir), "2024-01-05 or 13:45", "event_id", "ts", ["props"], confidence=F.least(F.col("value") / 100, F.lit(1.0)), least=0.2)
    return plain(r.select("id", "ts", "match_text", "confidence"))


@query("semantic_search", "SELECT event_id AS id, 'Semantic action' AS context, 'cess' AS match_text, instr(v, 'cess')::INTEGER - 1 AS start, instr(v, 'cess')::INTEGER + 3 AS \"end\" FROM (SELECT event_id, event_type || ' access' AS v FROM events)")
def semantic_search(spark, sf_dir):
    """SR-07: hits in semantic values of one category"""
    e = events(spark, sf_dir).withColumn("semantic", F.create_map(F.lit("action"), F.concat("source", F.lit(" access")), F.lit("note"), F.lit("no access")))
    return search.find_results(e, "cess", "event_id", "ts", ["props"], "semantic", ["action"], mode="semantic").select("id", "context", "match_text", "start", "end")


@query("combined_search", """
SELECT event_id AS id, 'Data event_type' AS context, instr(event_type, 'ur')::INTEGER - 1 AS start FROM events WHERE event_type LIKE '%ur%' UNION ALL SELECT event_id, 'Semantic kind', 1 FROM events WHERE user_id % 2 = 0""")
def combined_search(spark, sf_dir):
    """SR-07: texts and semantics together"""
    e = events(spark, sf_dir).withColumnRenamed("source", "event_type").withColumn("semantic", F.create_map(F.lit("kind"), F.when(F.col("user_id") % 2 == 0, "Purple").otherwise("green")))
    return search.find_results(e, "ur", "event_id", "ts", ["event_type"], "semantic", mode="combined").select("id", "context", "start")


@query("registry_risks", """
SELECT event_id, CASE event_type WHEN 'error' THEN 5 WHEN 'click' THEN 4 WHEN 'view' THEN 4 END AS start_severity, CASE event_type WHEN 'error' THEN 'tool_keyword' WHEN 'click' THEN 'suspicious_path' WHEN 'view' THEN 'temp_execution' END AS start_indicator,
  CASE WHEN user_id % 4 = 0 THEN 3 WHEN user_id % 4 = 1 AND event_type = 'error' THEN 5 WHEN user_id % 4 = 1 AND event_type = 'click' THEN 4 WHEN user_id % 4 = 1 THEN NULL END AS service_severity,
  CASE WHEN event_id % 3 = 0 THEN 'no_publisher' ELSE '' END || CASE WHEN event_type = 'error' THEN (CASE WHEN event_id % 3 = 0 THEN ',' ELSE '' END) || 'tool_keyword' ELSE '' END AS software, CASE WHEN user_id % 5 = 2 THEN 'CRITICAL' END AS updates FROM events""")
def registry_risks(spark, sf_dir):
    """RL-14: programs that start by themselves, services, software, updates"""
    s, u = F.col("source"), F.col("user_id")
    command = F.when(s == "error", "D:\\x\\PsExec.exe").when(s == "click", "C:\\Windows\\a.exe").when(s == "view", "d:\\attempt\\a.exe").otherwise("D:\\apps\\a.exe")
    name = F.when(u % 4 == 0, "").otherwise(F.when(s == "error", "nmap runner").otherwise("editor"))
    start = rules.start_risk(command)
    service = rules.service_risk(F.when(u % 4 < 2, 2).otherwise(3), F.when(s == "click", "c:\\tmp\\x").otherwise("d:\\x"), name, F.lit(""))
    software = rules.software_risks(F.when(s == "error", "Hashcat").otherwise("editor"), F.when(F.col("event_id") % 3 == 0, "").otherwise("maker"))
    return events(spark, sf_dir).select(
        "event_id", start["severity"].alias("start_severity"), start["indicator"].alias("start_indicator"), service["severity"].alias("service_severity"),
        F.array_join(F.transform(software, lambda x: x["indicator"]), ",").alias("software"), rules.update_risk(u % 5)["level"].alias("updates"),
    )


SIDS = ", ".join(f"('{v}', '{k}')" for v, k in rules.WELL_KNOWN_SIDS.items())


@query("default_dictionary", f"""
WITH p AS (SELECT 'S-1-5-21-' || c_nationkey AS value, c_mktsegment AS key, 'UserProfiles' AS source, 0 AS o FROM customer UNION ALL SELECT 'S-1-5-21-' || c_nationkey, 'C:/Users/' || c_mktsegment, 'UserProfiles', 1 FROM customer
  UNION ALL SELECT p_brand, p_type, 'services', 13 FROM part UNION ALL SELECT o_orderpriority, o_orderstatus, 'event_logs', 14 FROM orders UNION ALL SELECT v, k, 'Windows_Internals', 15 FROM (VALUES {SIDS}) t(v, k)),
f AS (SELECT value, key, min(o) AS o, arg_min(source, o) AS source FROM p GROUP BY ALL)
SELECT value, string_agg(key, ',' ORDER BY o, key) AS keys, arg_min(source, o) AS source FROM f GROUP BY value""")
def default_dictionary(spark, sf_dir):
    """EN-01, EN-03: the default rules whose tables are there, and the well-known ids"""
    c = load(spark, sf_dir, "customer")
    sid = F.concat(F.lit("S-1-5-21-"), F.col("c_nationkey").cast("string")).alias("user_sid")
    tables = {
        "UserProfiles": c.select(sid, F.col("c_mktsegment").alias("username"), F.concat(F.lit("C:/Users/"), "c_mktsegment").alias("profile_path")),
        "services": load(spark, sf_dir, "part").select(F.col("p_brand").alias("service_name"), F.col("p_type").alias("display_name")),
        "event_logs": load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("event_id"), F.col("o_orderstatus").alias("description")),
    }
    return rules.merge_dictionary(rules.default_pairs(spark, tables))


@query("stored_rules", """
WITH p AS (SELECT p_brand AS value, p_type AS key, 'part' AS source, 0 AS o FROM part UNION ALL SELECT c_mktsegment, c_nationkey::VARCHAR, 'customer', 1 FROM customer),
f AS (SELECT value, key, min(o) AS o, min(source) AS source FROM p GROUP BY ALL)
SELECT value, string_agg(key, ',' ORDER BY o, key) AS keys, arg_min(source, o) AS source FROM f GROUP BY value""")
def stored_rules(spark, sf_dir):
    """UD-04, EN-02: a user's rules stored, one replaced, one deleted, the rest applied"""
    store = rules.RuleStore(spark, fresh_path(spark))
    rule = rules.DictionaryRule
    store.save(rule("part", "p_brand", "p_name", "a brands", "Part"), rule("customer", "c_mktsegment", "c_nationkey", "b segments", "Customer"), rule("orders", "o_orderstatus", "o_orderpriority", "c orders", "Order"))
    store.save(rule("part", "p_brand", "p_type", "a brands", "Part"))
    store.delete("c orders")
    tables = {t: load(spark, sf_dir, t) for t in ("part", "customer", "orders")}
    return rules.merge_dictionary(rules.dictionary_pairs(tables, store.rules()))


@query("loaded_rules", "SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'r1' END, CASE WHEN event_type LIKE '%ic%' OR value > 90 THEN 'r2' END], lambda x: x IS NOT NULL), ',') AS rule_ids FROM events")
def loaded_rules(spark, sf_dir):
    """UD-03: rules as JSON documents in files"""
    docs = [
        '{"rule_id": "r1", "label": "failure", "conditions": [{"field": "source", "operator": "equals", "value": "ERROR"}]}',
        '{"rule_id": "r2", "label": "click or large", "logic": "OR", "conditions": [{"field": "source", "operator": "contains", "value": "ic"}, {"field": "value", "operator": "greater_than", "value": "90"}]}',
        '{"rule_id": "r3", "label": "says nothing", "conditions": []}',
    ]
    path = fresh_path(spark)
    spark.createDataFrame([(d,) for d in docs], "value string").write.text(path)
    return rules.tag_rows(events(spark, sf_dir), rules.load_rules(spark, path)).select("event_id", F.array_join("rule_ids", ",").alias("rule_ids"))


@query("indicator_fallback", "SELECT p_brand || 'é' AS value, p_type AS key, 'list' AS source, count(*) AS n FROM part GROUP BY ALL")
def indicator_fallback(spark, sf_dir):
    """SRC-16: an indicator list in an unknown encoding with an unknown delimiter"""
    p = fresh_path(spark)
    part = load(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("é")).alias("value"), F.col("p_type").alias("key"))
    io.export(part, p, "csv", sep=";", encoding="ISO-8859-1")
    return io.read_indicators_any(spark, p).groupBy("value", "key", "source").agg(F.count(F.lit(1)).alias("n"))


@query("timeline_resolved", """
SELECT l_orderkey AS row_id, coalesce(s_name, 'App ID ' || l_suppkey::VARCHAR) AS display_name, l_shipdate AS ts FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_suppkey % 3 > 0""")
def timeline_resolved(spark, sf_dir):
    """TL-04: ids shown by name inside a lane"""
    lane = timeline.Lane("line", "lineitem", "l_orderkey", (("l_shipdate", "shipped"),), name_id=("l_suppkey", "App ID"))
    names = load(spark, sf_dir, "supplier").filter("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return plain(timeline.timeline({"lineitem": load(spark, sf_dir, "lineitem")}, [lane], names=names).select("row_id", "display_name", "ts"))


@query("stream_appended", "SELECT event_id AS match_id, user_id, ts FROM events WHERE event_type = 'error'")
def stream_appended(spark, sf_dir):
    """SNK-04: matches of a stream appended batch by batch"""
    base = fresh_path(spark)
    store = ResultStore(spark, base)
    found = events_stream(spark, sf_dir).filter("source = 'error'").select(F.col("event_id").alias("match_id"), "user_id", "ts")
    store.append_stream("matches", found, f"{base}/state").awaitTermination()
    return plain(store.read("matches").select("match_id", "user_id", "ts"))


@query("power_kinds", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'power_on' WHEN 1 THEN 'power_off' WHEN 2 THEN 'sleep' WHEN 3 THEN 'wake' WHEN 4 THEN 'login' END AS kind FROM orders WHERE o_orderkey % 6 < 5")
def power_kinds(spark, sf_dir):
    """WN-14"""
    ids = F.element_at(F.array(*[F.lit(i) for i in (12, 6006, 42, 107, 4624, 99)]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return ordered.power_events(load(spark, sf_dir, "orders").withColumn("event_id", ids)).select("o_orderkey", "kind")


GROUPS = f"""{ISLANDS}, a AS (SELECT user_id, island, min(ts) AS start_ts, max(ts) AS end_ts FROM i GROUP BY ALL),
d AS (SELECT start_ts, row_number() OVER (ORDER BY start_ts) AS rn FROM (SELECT DISTINCT start_ts FROM a)),
r AS (SELECT rn, start_ts, start_ts AS g FROM d WHERE rn = 1 UNION ALL SELECT d.rn, d.start_ts, CASE WHEN epoch_us(d.start_ts) - epoch_us(r.g) > 3600000000 THEN d.start_ts ELSE r.g END FROM r JOIN d ON d.rn = r.rn + 1),
e AS (SELECT r.g AS group_start, a.user_id, a.start_ts, a.end_ts, i.event_type FROM a JOIN r USING (start_ts) JOIN i ON i.user_id = a.user_id AND i.island = a.island),
t AS (SELECT group_start, string_agg(event_type, ',' ORDER BY n DESC, event_type) AS top3 FROM (SELECT group_start, event_type, count(*) AS n, row_number() OVER (PARTITION BY group_start ORDER BY count(*) DESC, event_type) AS rn FROM e GROUP BY group_start, event_type) WHERE rn <= 3 GROUP BY 1),
s AS (SELECT group_start, count(DISTINCT user_id) AS n_identities, min(start_ts) AS first_ts, max(end_ts) AS last_ts, count(*) AS n_evidence FROM e GROUP BY 1)"""


def anchor_groups(spark, sf_dir):
    """Groups of anchors over one order of all starts, with their totals."""
    name = F.concat_ws("-", F.col("user_id").cast("string"), F.col("island").cast("string")).alias("anchor_id")
    e = events(spark, sf_dir)
    rows = ordered.islands(e, ["user_id"], "ts", 10_800).select(name, F.col("source").alias("kind"))
    anchors = ordered.gap_clusters(e, ["user_id"], "ts", 10_800).select(name, "user_id", "start_ts", "end_ts")
    groups = ordered.anchor_time_groups(anchors, [], "start_ts", "anchor_id", 3600)
    return aggs.anchor_group_totals(groups, rows, "group_start", "start_ts", "end_ts", "user_id", "kind", "anchor_id").withColumn("top3", F.array_join("top3", ","))


@query("anchor_group_totals", f"WITH RECURSIVE {GROUPS} SELECT group_start, n_identities, first_ts, last_ts, n_evidence, top3 FROM s JOIN t USING (group_start)")
def anchor_group_totals(spark, sf_dir):
    """AG-40"""
    return plain(anchor_groups(spark, sf_dir).select("group_start", "n_identities", "first_ts", "last_ts", "n_evidence", "top3"))


@query("anchor_groups_paged", f"WITH RECURSIVE {GROUPS} SELECT group_start, n_identities, n_evidence FROM s WHERE group_start BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25' ORDER BY group_start LIMIT 25 OFFSET 25")
def anchor_groups_paged(spark, sf_dir):
    """QRY-03: the second page of groups in time order"""
    from datetime import datetime, timezone

    day = lambda *d: datetime(*d, tzinfo=timezone.utc)
    g = search.groups_by(anchor_groups(spark, sf_dir), "time", day(2024, 1, 3), day(2024, 1, 25))
    return plain(search.page(g, ["group_start"], 2, 25).select("group_start", "n_identities", "n_evidence"))
