"""Queries: files written and read back, stored results, configuration tables, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.functions import textfn as X
from evspark.functions import timefn as TS
from evspark.operators import aggs, correlate, rules, search
from evspark.plans.registry import query
from evspark.plans.tables import events, load, plain
from evspark.sources import io, sqlite
from evspark.sources.store import ResultStore
from evspark.storage import fresh_path
from evspark.streaming.run import read_files


@query("csv_roundtrip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_roundtrip(spark, sf_dir):
    """SNK-02, SRC-04: delimited text out and in, all columns text"""
    p = fresh_path(spark)
    io.export(load(spark, sf_dir, "customer"), p, "csv", ["c_custkey", "c_name", "c_mktsegment"], sep="|")
    return io.read_delimited(spark, p, "pipe").select("c_custkey", "c_name", "c_mktsegment")


@query("json_roundtrip", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1")
def json_roundtrip(spark, sf_dir):
    """SNK-01, SRC-05: nested JSON out and in; values by dotted paths"""
    p = fresh_path(spark)
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.struct(F.count(F.lit(1)).alias("n"), F.array(F.struct(F.max("o_totalprice").alias("top"))).alias("list")).alias("stats"))
    io.export(o, p, "json")
    df = io.read_json(spark, p)
    return df.select("o_custkey", io.nested(df.schema, "stats.n").alias("n"), io.nested(df.schema, "stats.list.top").alias("top"))


@query("xml_roundtrip", "SELECT n_nationkey, n_name FROM nation")
def xml_roundtrip(spark, sf_dir):
    """SNK-02"""
    p = fresh_path(spark)
    io.export(load(spark, sf_dir, "nation"), p, "xml", ["n_nationkey", "n_name"])
    return spark.read.format("xml").option("rowTag", "match").schema("n_nationkey long, n_name string").load(p)


@query("stored_results", "SELECT l_orderkey AS result_id, l_linenumber AS match_no, o_custkey % 5 AS execution_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 = 3")
def stored_results(spark, sf_dir):
    """SNK-03, QRY-07: matches stored by execution, one execution read back"""
    store = ResultStore(spark, fresh_path(spark))
    m = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    store.append("matches", m.select(F.col("l_orderkey").alias("result_id"), F.col("l_linenumber").alias("match_no"), (F.col("o_custkey") % 5).alias("execution_id")))
    return store.read("matches", 3).select("result_id", "match_no", F.col("execution_id").cast("long").alias("execution_id"))


@query("stored_reruns", "SELECT event_type AS source, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE event_type <> 'view' GROUP BY 1")
def stored_reruns(spark, sf_dir):
    """SNK-03, SNK-04: runs and a stream that share a table; each runs twice, one with other rows first, a write fails"""
    store, e = ResultStore(spark, fresh_path(spark)), events(spark, sf_dir)
    rows = lambda s: e.filter(F.col("source") == s).select(F.col("source").alias("execution_id"), "event_id", "user_id")
    for _ in range(2):
        store.append("matches", rows("click"))
        store.append("matches", rows("error").withColumn("score", F.lit(0.5)))
    store.commit("matches", e.select("event_id", "user_id"), "late run")
    store.commit("matches", rows("signup"), "late run")
    try:
        store.commit("matches", rows("view").select("*", F.raise_error(F.lit("no"))), "broken run")
    except Exception as broken:  # noqa: BLE001  the write ends in the error that it was given
        assert "no" in str(broken)
    found = read_files(spark, f"{sf_dir}/events.parquet").filter("event_type = 'purchase'").select(F.col("event_type").alias("execution_id"), "event_id", "user_id")
    for _ in range(2):
        store.append_stream("matches", found, f"{store.path}/_state").awaitTermination()
    return store.read("matches").groupBy(F.col("execution_id").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("database_table", "SELECT o_orderpriority, count(*) AS n, sum(o_custkey)::BIGINT AS custkeys, max(o_totalprice) AS top FROM orders WHERE o_orderkey > 500 AND o_orderstatus = 'F' GROUP BY 1")
def database_table(spark, sf_dir):
    """SRC-06, SRC-02: orders written to SQLite files and read back by ranges of rows, filters in the files' queries"""
    path, orders = fresh_path(spark), load(spark, sf_dir, "orders")
    sqlite.write_database(orders.repartition(max(3, orders.count() // 500_000)), path, "orders")  # a file a task
    df = sqlite.read_database(spark, path, "orders", rows=10_000).filter("o_orderkey > 500 AND o_orderstatus = 'F'")
    return df.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("custkeys"), F.max("o_totalprice").alias("top"))


@query("indicator_files", "SELECT p_brand AS value, p_type AS key, 'list' AS source, count(*) AS n FROM part GROUP BY ALL")
def indicator_files(spark, sf_dir):
    """SRC-16: an indicator list as a file"""
    p = fresh_path(spark)
    io.export(load(spark, sf_dir, "part"), p, "csv", ["p_brand", "p_type"], sep=";")
    return io.read_indicators(spark, p, "p_brand", "p_type", "list", delimiter="semicolon").groupBy("value", "key", "source").agg(F.count(F.lit(1)).alias("n"))


@query("effective_weights", """
WITH s AS (SELECT DISTINCT event_type AS source, CASE WHEN event_type IN ('view', 'click') THEN 'web' WHEN event_type = 'error' THEN 'log' ELSE 'shop' END AS t FROM events)
SELECT source, CASE WHEN source = 'purchase' THEN 0.9 WHEN t = 'web' THEN 0.4 WHEN t = 'log' THEN 0.2 ELSE 0.1 END::DOUBLE AS weight FROM s""")
def effective_weights(spark, sf_dir):
    """SC-06"""
    t = F.when(F.col("source").isin("view", "click"), "web").when(F.col("source") == "error", "log").otherwise("shop")
    s = events(spark, sf_dir).groupBy("source").count().select("source", t.alias("artifact_type"))
    return correlate.effective_weights(s, spark.createDataFrame([("purchase", 0.9), ("view", 0.0)], "source string, weight double"), spark.createDataFrame([("web", 0.4)], "artifact_type string, weight double"), spark.createDataFrame([("log", 0.2), ("web", 0.9)], "artifact_type string, weight double"))


@query("rescored_matches", """
SELECT user_id AS match_id, round(sum(w), 2) AS score, CASE WHEN round(sum(w), 2) >= 0.9 THEN 'High' WHEN round(sum(w), 2) >= 0.5 THEN 'Medium' ELSE 'Unknown' END AS label
FROM (SELECT DISTINCT user_id, event_type, CASE event_type WHEN 'purchase' THEN 0.5 WHEN 'error' THEN 0.3 ELSE 0.0 END::DOUBLE AS w FROM events WHERE value > 90) GROUP BY 1""")
def rescored_matches(spark, sf_dir):
    """SC-07 over rows of high value, a predicate of the search: of all rows every match has all sources"""
    e = events(spark, sf_dir).filter("value > 90").withColumnRenamed("user_id", "match_id")
    old = e.groupBy("match_id").agg(F.lit(0.0).alias("score"), F.lit("old").alias("label"))
    w = spark.createDataFrame([("purchase", 0.5), ("error", 0.3)], "source string, weight double")
    return correlate.rescore(old, e, "match_id", "source", w, [(0.9, "High"), (0.5, "Medium")]).select("match_id", "score", "label")


@query("sql_functions", "SELECT event_id, regexp_matches(event_type, '(?i)^CL|err') AS hit, round(CASE WHEN event_id % 2 = 0 THEN value * 1024 ELSE 0 END, 3) AS n FROM events")
def sql_functions(spark, sf_dir):
    """UD-01, UD-02 from SQL"""
    X.register(spark)
    events(spark, sf_dir).createOrReplaceTempView("evspark_events")
    return spark.sql("SELECT event_id, regexp_ci('^CL|err', source) AS hit, round(parsable_num(CASE WHEN event_id % 2 = 0 THEN concat(value, ' KB') ELSE 'none' END), 3) AS n FROM evspark_events")


@query("viewer_filter", """
WITH d AS (SELECT DISTINCT epoch_us(ts) // 10800000000 AS k, user_id, event_type, ts FROM events),
g AS (SELECT k, user_id, count(DISTINCT event_type) AS n_sources, max((event_type = 'click')::INT) AS c, min(ts) AS a, max(ts) AS b FROM d GROUP BY ALL HAVING count(DISTINCT event_type) >= 2)
SELECT make_timestamp(k * 10800000000) AS window_start, user_id, n_sources FROM g WHERE c = 1 AND user_id::VARCHAR LIKE '%1%' AND b >= TIMESTAMP '2024-01-05' AND a <= TIMESTAMP '2024-01-20'""")
def viewer_filter(spark, sf_dir):
    """CW-05"""
    from datetime import datetime, timezone

    w = correlate.windows(events(spark, sf_dir), "ts", 10_800)
    m = correlate.correlate_windows(w, "user_id", "source", "ts", 2).withColumn("identity", F.col("user_id").cast("string"))
    return plain(correlate.view_filter(m, "1", "click", datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 20, tzinfo=timezone.utc)).select("window_start", "user_id", "n_sources"))


@query("identity_matches", "SELECT p_partkey FROM part WHERE p_name ILIKE '%red%'")
def identity_matches(spark, sf_dir):
    """RL-12"""
    return rules.of_identity(load(spark, sf_dir, "part"), "p_name", "%RED%").select("p_partkey")


@query("first_times", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END AS t FROM orders")
def first_times(spark, sf_dir):
    """TS-12: the first raw column that parses"""
    k = F.col("o_orderkey") % 3
    said = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return plain(load(spark, sf_dir, "orders").select("o_orderkey", TS.first_time([F.when(k == 1, said).otherwise("n/a"), F.when(k == 2, said), F.lit("")]).alias("t")))


@query("audit_summary", "SELECT event_type AS action, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_t, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_t FROM events GROUP BY 1")
def audit_summary(spark, sf_dir):
    """AG-36: events as log lines"""
    lines = events(spark, sf_dir).select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), "source", F.lit("] user "), F.col("user_id").cast("string")).alias("value"))
    return aggs.audit_summary(lines)


WHOLE_WORD_SQL = r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents) WHERE lower(w) = '%s' GROUP BY 1"


@query("whole_word_search", WHOLE_WORD_SQL % "und")
def whole_word_search(spark, sf_dir):
    """SR-07, another word in all documents"""
    return search.find_in_text(load(spark, sf_dir, "documents"), "text", "und", "word", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("whole_word_search_all", WHOLE_WORD_SQL % "the")
def whole_word_search_all(spark, sf_dir):
    """SR-07, whole words in all documents"""
    return search.find_in_text(load(spark, sf_dir, "documents"), "text", "the", "word", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("stamped_evidence", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY 1")
def stamped_evidence(spark, sf_dir):
    """SRC-08, TL-06: evidence tables by source, united again"""
    e = events(spark, sf_dir)
    parts = {s: e.filter(F.col("source") == s).select("event_id", "user_id", "value") for s in ("view", "click", "purchase", "signup", "error")}
    m = [{"table": s, "columns": {"user_id": ("user id", "bigint"), "value": ("value", "double")}, "source_tool": "web", "artifact_type": s, "key": ["event_id"]} for s in parts]
    u = aggs.union_all(list(io.build_evidence(parts, m).values()))
    return u.groupBy("user_id").agg(F.count_distinct("artifact_id").alias("n"), F.count_if(F.col("artifact_type") == "view").alias("n_view"))
