"""Queries: time and text functions, predicates, rules, dictionaries, search, timeline, sources, inference."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from evspark.functions import predicates as P
from evspark.functions import textfn as X
from evspark.functions import timefn as TS
from evspark.operators import gram_index, infer, rules, search, timeline
from evspark.operators.rule_index import RuleIndex
from evspark.plans.registry import query
from evspark.plans.tables import events, load, plain
from evspark.sources import io

day = lambda *d: datetime(*d, tzinfo=timezone.utc)


# time


@query("filetime_roundtrip", "SELECT event_id, (epoch_us(ts) + 11644473600000000) * 10 AS filetime, ts AS back FROM events")
def filetime_roundtrip(spark, sf_dir):
    """TS-01"""
    e = events(spark, sf_dir).withColumn("filetime", TS.ts_to_filetime(F.col("ts")))
    return plain(e.select("event_id", "filetime", TS.filetime_to_ts(F.col("filetime")).alias("back")))


@query("systemtime_roundtrip", "SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS back FROM events")
def systemtime_roundtrip(spark, sf_dir):
    """TS-02: to 16 bytes and back, to the millisecond"""
    return plain(events(spark, sf_dir).select("event_id", TS.systemtime_to_ts(TS.ts_to_systemtime(F.col("ts"))).alias("back")))


@query("ts_ladder", """
SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS s, make_timestamp(epoch_us(ts) // 1000 * 1000) AS ms, ts AS us, make_timestamp(epoch_us(ts) // 86400000000 * 86400000000) AS days, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS any_s FROM events""")
def ts_ladder(spark, sf_dir):
    """TS-03, TS-04, TS-07"""
    t = F.unix_micros("ts")
    s, ms, d = F.floor(t / 1_000_000), F.floor(t / 1000), F.floor(t / 86_400_000_000)
    return plain(events(spark, sf_dir).select("event_id", TS.unix_to_ts(s).alias("s"), TS.unix_to_ts(ms).alias("ms"), TS.unix_to_ts(t).alias("us"), TS.epoch_days_to_ts(d).alias("days"), TS.parse_any(s.cast("string")).alias("any_s")))


@query("ts_strings", "SELECT o_orderkey, o_orderdate AS iso, o_orderdate AS slash_us, o_orderdate AS imported, CASE WHEN year(o_orderdate) >= 1997 THEN o_orderdate END AS gated FROM orders")
def ts_strings(spark, sf_dir):
    """TS-04, TS-06, TS-08, TS-15: written in a layout and parsed again"""
    o = load(spark, sf_dir, "orders")
    said = lambda p: F.date_format("o_orderdate", p)
    return plain(o.select("o_orderkey", TS.parse_any(said("yyyy-MM-dd'T'HH:mm:ss"), "evidence").alias("iso"), TS.parse_slash(said("MM/dd/yyyy")).alias("slash_us"), TS.import_time(said("dd-MM-yyyy HH:mm:ss")).alias("imported"), TS.in_years(F.col("o_orderdate"), 1997, 2100).alias("gated")))


@query("ts_formats", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'unix_s' WHEN 1 THEN 'unix_ms' WHEN 2 THEN 'iso8601' WHEN 3 THEN 'sql' WHEN 4 THEN 'slash_us' ELSE 'filetime' END AS format, CASE event_id % 6 WHEN 4 THEN 0.7::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM events""")
def ts_formats(spark, sf_dir):
    """TS-05, TS-09"""
    t, k = F.unix_micros("ts"), F.col("event_id") % 6
    said = lambda p: F.date_format("ts", p)
    raw = F.when(k == 0, F.floor(t / 1_000_000).cast("string")).when(k == 1, F.floor(t / 1000).cast("string")).when(k == 2, said("yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, said("yyyy-MM-dd HH:mm:ss")).when(k == 4, said("MM/dd/yyyy HH:mm:ss")).otherwise(TS.ts_to_filetime(F.col("ts")).cast("string"))
    got = TS.parse_resilient(raw)
    return events(spark, sf_dir).select("event_id", got.alias("g")).select("event_id", "g.format", "g.confidence")


@query("ts_display", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS shown, ts + INTERVAL 5 HOUR AS from_zone FROM events")
def ts_display(spark, sf_dir):
    """TS-10"""
    return plain(events(spark, sf_dir).select("event_id", TS.display(F.col("ts"), "yyyy/MM/dd HH:mm").alias("shown"), TS.to_utc(F.col("ts"), "UTC-05:00").alias("from_zone")))


@query("multi_times", """
WITH l AS (SELECT o_custkey, list(strftime(o_orderdate, '%Y-%m-%d')) AS t FROM orders GROUP BY 1) SELECT o_custkey, unnest(t) AS t, len(t)::INTEGER AS n FROM l""")
def multi_times(spark, sf_dir):
    """TS-11: a JSON array of times a customer, one row each"""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("t"), F.count(F.lit(1)).cast("int").alias("n"))
    return TS.explode_times(o, "t").select("o_custkey", "t", "n")


@query("family_time", "SELECT event_id, CASE event_type WHEN 'view' THEN ts WHEN 'click' THEN ts + INTERVAL 1 HOUR END AS t FROM events")
def family_time(spark, sf_dir):
    """TS-12, TS-14: each source has its own list of time columns"""
    e = events(spark, sf_dir).withColumn("late", F.expr("ts + interval 1 hour"))
    return plain(e.select("event_id", TS.event_time_by_family(F.col("source"), {"view": [F.col("ts"), F.col("late")], "click": [F.lit(None).cast("timestamp"), F.col("late")]}).alias("t")))


# text


@query("path_keys", r"""
WITH p AS (SELECT page_id, replace(url, 'http://', 'C:\Users\Bob//') AS u FROM pages)
SELECT page_id, regexp_replace(replace(lower(trim(u)), '\', '/'), '/+', '/', 'g') AS path, nullif(regexp_extract(u, '([^/\\]*)$', 1), '') AS name, nullif(regexp_extract(lower(u), '(?:/|\\)users(?:/|\\)([^/\\]+)', 1), '') AS username FROM p""")
def path_keys(spark, sf_dir):
    """STR-01..STR-03, STR-19"""
    p = load(spark, sf_dir, "pages").select("page_id", F.replace("url", F.lit("http://"), F.lit("C:\\Users\\Bob//")).alias("u"))
    return p.select("page_id", X.normal_path(F.col("u")).alias("path"), X.file_name(F.col("u")).alias("name"), X.user_of_path(F.col("u")).alias("username"))


@query("name_keys", """
SELECT p_partkey, upper(p_name) || ' v1.2.EXE' AS raw, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS app_key, p_name || ' v' || (p_partkey % 7)::VARCHAR || '.0' AS versioned, p_name AS base, 'v' || (p_partkey % 7)::VARCHAR || '.0' AS suffix,
  regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '|c:/x|' AS composite FROM part""")
def name_keys(spark, sf_dir):
    """STR-04..STR-07"""
    p = load(spark, sf_dir, "part").withColumn("raw", F.concat(F.upper("p_name"), F.lit(" v1.2.EXE"))).withColumn("versioned", F.concat("p_name", F.lit(" v"), (F.col("p_partkey") % 7).cast("string"), F.lit(".0")))
    b = X.base_and_suffix(F.col("versioned"))
    return p.select("p_partkey", "raw", X.app_key(F.col("raw")).alias("app_key"), "versioned", b["base"].alias("base"), b["suffix"].alias("suffix"), X.composite_key(F.col("versioned"), F.lit("C:\\X\\"), F.lit(None).cast("string")).alias("composite"))


@query("scan_identities", """
WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name || ' of the ' || p_type), '\\s+'), lambda x: x <> '' AND x NOT IN ('the', 'of')) AS t FROM part) SELECT p_partkey, array_to_string(t, ' ') AS identity FROM w""".replace("\\\\", "\\"))
def scan_identities(spark, sf_dir):
    """STR-08"""
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", X.scan_identity(F.concat("p_name", F.lit(" 12 of the "), "p_type", F.lit(".exe"))).alias("identity"))


@query("command_programs", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'C:/' || p_name || '.exe' ELSE split_part(p_name, ' ', 1) END AS program, true AS is_command FROM part""")
def command_programs(spark, sf_dir):
    """STR-09"""
    p = load(spark, sf_dir, "part")
    c = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"C:/'), "p_name", F.lit('.exe" -x'))).otherwise(F.concat("p_name", F.lit(" -y")))
    return p.select("p_partkey", X.command_program(c).alias("program"), X.is_command_line(c).alias("is_command"))


@query("identity_info", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand || '.exe' END AS name, 'c/' || p_brand || '.exe' AS path, CASE WHEN p_partkey % 5 = 0 THEN 'h' || p_partkey::VARCHAR END AS hash, CASE WHEN p_partkey % 5 = 0 THEN 'hash' ELSE 'path' END AS type FROM part""")
def identity_info(spark, sf_dir):
    """STR-10, STR-11, STR-16"""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    i = X.identity_info([F.when(k % 3 == 0, F.col("p_name")).otherwise(F.lit(" "))], [F.concat(F.lit("c/"), "p_brand", F.lit(".exe"))], [F.when(k % 5 == 0, F.concat(F.lit("h"), k.cast("string")))])
    return p.select("p_partkey", i.alias("i")).select("p_partkey", "i.name", "i.path", "i.hash", "i.type")


@query("discovered_fields", "SELECT p_partkey, 'p_name' AS field, p_name AS value, 10 AS score FROM part")
def discovered_fields(spark, sf_dir):
    """STR-12"""
    f = X.discover_identity(["p_brand", "p_name", "p_type"])
    return load(spark, sf_dir, "part").select("p_partkey", f.alias("f")).select("p_partkey", "f.field", "f.value", "f.score")


@query("identity_problems", """
WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'true' WHEN 1 THEN value::INTEGER::VARCHAR || '.5' WHEN 2 THEN 'x' WHEN 3 THEN '--' WHEN 4 THEN '  ' ELSE event_type END AS k, event_id % 6 AS m FROM events)
SELECT CASE m WHEN 0 THEN 'boolean_string' WHEN 1 THEN 'numeric_value' WHEN 2 THEN 'too_short' WHEN 3 THEN 'no_alphanumeric' WHEN 4 THEN 'whitespace_only' END AS problem, count(*) AS n FROM v GROUP BY 1""")
def identity_problems(spark, sf_dir):
    """STR-13"""
    m = F.col("event_id") % 6
    v = F.when(m == 0, "true").when(m == 1, F.concat(F.floor("value").cast("string"), F.lit(".5"))).when(m == 2, "x").when(m == 3, "--").when(m == 4, "  ").otherwise(F.col("source"))
    return events(spark, sf_dir).groupBy(X.identity_problem(v).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


@query("identity_kinds", """
SELECT source, CASE WHEN source LIKE '%1%' THEN 'file' ELSE 'application' END AS kind, count(*) AS n FROM documents GROUP BY ALL""")
def identity_kinds(spark, sf_dir):
    """STR-14, STR-15: sources whose number has a 1 pass for link files"""
    s = F.when(F.col("source").contains("1"), F.concat(F.lit("lnk_"), "source")).otherwise(F.col("source"))
    return load(spark, sf_dir, "documents").filter(X.is_match_identity(F.concat(F.lit("x"), "lang"), F.col("source")) | F.col("lang").isNull()).groupBy("source", X.type_by_source(s).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("path_similarity", r"""
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(lower(trim(url)), '/+', '/', 'g'), '/'), lambda x: x <> '') AS a FROM pages),
q AS (SELECT x.page_id, x.a, y.a AS b FROM p x JOIN p y ON y.page_id = x.page_id + 1)
SELECT page_id, round(len(list_filter(a, lambda z: list_contains(b, z))) / greatest(len(a), len(b))::DOUBLE, 9) AS similarity FROM q""")
def path_similarity(spark, sf_dir):
    """STR-17: neighbouring pages"""
    p = load(spark, sf_dir, "pages").select("page_id", "url")
    q = p.join(p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other")), "page_id")
    return q.select("page_id", F.round(X.path_similarity(F.col("url"), F.col("other")), 9).alias("similarity"))


@query("edit_distance", "SELECT x.n_name AS a, y.n_name AS b, levenshtein(x.n_name, y.n_name)::INTEGER AS distance FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
def edit_distance(spark, sf_dir):
    """STR-18"""
    n = load(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("a"), F.col("n_nationkey").alias("i")), n.select("n_regionkey", F.col("n_name").alias("b"), F.col("n_nationkey").alias("j"))
    return a.join(b, "n_regionkey").filter("i < j").select("a", "b", X.edit_distance(F.col("a"), F.col("b")).alias("distance"))


@query("canonical_names", """
SELECT event_id, CASE event_type WHEN 'view' THEN 'Google Chrome' WHEN 'click' THEN 'Python' ELSE event_type END AS app, '%Windows%' || chr(92) || event_type AS path FROM events""")
def canonical_names(spark, sf_dir):
    """STR-20"""
    s = F.col("source")
    raw = F.when(s == "view", "C:\\CHROME.EXE").when(s == "click", "python.exe x").otherwise(s)
    return events(spark, sf_dir).select("event_id", X.canonical_app(raw).alias("app"), X.canonical_path(F.concat(F.lit("C:\\Windows\\"), s)).alias("path"))


@query("parsed_numbers", """
SELECT event_id, round(CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN value * 1048576 WHEN 2 THEN (event_id % 9) * 3600 + (event_id % 60) * 60 WHEN 3 THEN event_id * 1000 + 5 ELSE 0 END, 2) AS n FROM events""")
def parsed_numbers(spark, sf_dir):
    """STR-21, UD-02"""
    i, v = F.col("event_id"), F.col("value").cast("string")
    raw = F.when(i % 5 == 0, v).when(i % 5 == 1, F.concat(v, F.lit(" MB"))).when(i % 5 == 2, F.concat((i % 9).cast("string"), F.lit("h "), (i % 60).cast("string"), F.lit("m"))).when(i % 5 == 3, F.concat(i.cast("string"), F.lit(",005"))).otherwise("unknown")
    return events(spark, sf_dir).select("event_id", F.round(X.parse_num(raw), 2).alias("n"))


@query("flag_names", """
WITH n AS (SELECT DISTINCT o_custkey % 64 AS f FROM orders)
SELECT f, CASE WHEN f % 64 & 55 = 0 THEN 'NORMAL' ELSE array_to_string(list_filter([CASE WHEN f & 1 > 0 THEN 'READONLY' END, CASE WHEN f & 2 > 0 THEN 'HIDDEN' END, CASE WHEN f & 4 > 0 THEN 'SYSTEM' END, CASE WHEN f & 16 > 0 THEN 'DIRECTORY' END, CASE WHEN f & 32 > 0 THEN 'ARCHIVE' END], lambda x: x IS NOT NULL), '|') END AS names FROM n""")
def flag_names(spark, sf_dir):
    """STR-22, STR-23"""
    n = load(spark, sf_dir, "orders").select((F.col("o_custkey") % 64).alias("f")).distinct()
    return n.select("f", X.flags_to_text(F.col("f"), X.FILE_ATTRIBUTES, "NORMAL").alias("names"))


@query("file_properties", "SELECT p_partkey, '.' || lower(split_part(p_name, ' ', 2)) AS extension, p_size & 16 > 0 AS is_directory, p_size & 2 > 0 AS is_hidden, p_size % 4 = 0 AS is_noise FROM part")
def file_properties(spark, sf_dir):
    """STR-23, STR-24"""
    p = load(spark, sf_dir, "part")
    f = X.file_properties(F.translate("p_name", " ", "."), F.col("p_size"))
    noise = X.is_tool_noise(F.when(F.col("p_size") % 4 == 0, "a.TMP").otherwise("a.txt"))
    return p.select("p_partkey", f.alias("f"), noise.alias("is_noise")).select("p_partkey", "f.extension", "f.is_directory", "f.is_hidden", "is_noise")


@query("resolved_names", "SELECT c_custkey, coalesce(n_name || ' (' || c_nationkey::VARCHAR || ')', 'Nation ' || c_nationkey::VARCHAR) AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey > 3")
def resolved_names(spark, sf_dir):
    """STR-26"""
    n = load(spark, sf_dir, "nation").filter("n_nationkey > 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = load(spark, sf_dir, "customer").join(n, "c_nationkey", "left")
    return j.select("c_custkey", X.resolved_name(F.col("n_name"), F.col("c_nationkey"), "Nation", True).alias("nation"))


@query("entities", r"""
SELECT page_id, len(regexp_extract_all(url, '(?:[A-Z]:\\[\w\s\\.\\-]+)|(?:/[\w/\\.\\-]+)'))::INTEGER AS paths, len(regexp_extract_all(url, '(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})|(?:[0-9a-fA-F:]+::[0-9a-fA-F:]+)'))::INTEGER AS ips FROM pages""")
def entities(spark, sf_dir):
    """STR-27"""
    e = load(spark, sf_dir, "pages").select("page_id", X.entities(F.col("url")).alias("e"))
    return e.select("page_id", F.size("e.file_path").alias("paths"), F.size("e.ip_address").alias("ips"))


@query("entity_confidence", """
SELECT event_id, round(least(0.3::DOUBLE + CASE WHEN event_id % 2 = 0 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN event_id % 3 = 0 THEN 0.2::DOUBLE * 1.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE), 9) AS confidence FROM events""")
def entity_confidence(spark, sf_dir):
    """STR-28: texts made of an event's time, an event id on even rows and two addresses on every third"""
    i = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(i % 2 == 0, " Event 4624").otherwise(""), F.when(i % 3 == 0, " 10.0.0.1 and 10.0.0.2").otherwise(""))
    return events(spark, sf_dir).select("event_id", F.round(X.entity_confidence(X.entities(text)), 9).alias("confidence"))


@query("payload_fields", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Unknown' ELSE event_type END AS f5 FROM events")
def payload_fields(spark, sf_dir):
    """STR-29"""
    raw = F.concat(F.lit("a,b,c,d,e,"), F.when(F.col("event_id") % 4 == 0, F.lit(" ")).otherwise(F.col("source")), F.lit(",z"))
    return events(spark, sf_dir).select("event_id", X.payload_field(raw, 5).alias("f5"))


@query("typed_identities", r"""
WITH p AS (SELECT page_id, regexp_replace(lower(trim(url)), '/+', '/', 'g') AS u FROM pages)
SELECT type, value, count(*) AS n FROM (SELECT DISTINCT page_id, unnest(['path', 'name', 'name']) AS type, unnest([u, nullif(regexp_extract(u, '([^/]*)$', 1), ''), 'page']) AS value FROM p) WHERE value IS NOT NULL GROUP BY ALL""")
def typed_identities(spark, sf_dir):
    """STR-31"""
    p = load(spark, sf_dir, "pages").select("page_id", F.explode(X.typed_identities([F.lit("Page")], [F.col("url")])).alias("i"))
    return p.groupBy("i.type", "i.value").agg(F.count(F.lit(1)).alias("n"))


@query("json_user", "SELECT event_id, props ->> '$.k' = '42' AS hit FROM events")
def json_user(spark, sf_dir):
    """JSON-01"""
    return events(spark, sf_dir).select("event_id", X.json_equals(F.col("props"), "$.k", "42").alias("hit"))


@query("payload_maps", "SELECT user_id, count(DISTINCT event_type) AS n_sources, count(*) AS n_records FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def payload_maps(spark, sf_dir):
    """JSON-02, AG-24: payload maps of source -> records; every third record is metadata"""
    from evspark.operators.aggs import stamp_identity

    r = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("_metadata"), F.lit("1"))).otherwise(F.create_map(F.lit("id"), F.col("event_id").cast("string")))
    per = events(spark, sf_dir).groupBy("user_id", "source").agg(F.collect_list(r).alias("records"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "records"))).alias("payload"))
    m = m.withColumn("payload", stamp_identity(X.without_metadata(F.col("payload")), F.col("user_id").cast("string"), F.lit("user")))
    n = F.aggregate(F.map_values("payload"), F.lit(0), lambda a, x: a + F.size(F.filter(x, lambda r: r["identity_type"] == "user")))
    return m.select("user_id", F.size("payload").cast("long").alias("n_sources"), n.cast("long").alias("n_records")).filter("n_sources > 0")


# predicates


@query("wildcard_filter", "SELECT p_partkey FROM part WHERE p_name ILIKE 'red%' AND p_brand <> 'Brand#3' AND p_type IN ('ECONOMY', 'STANDARD')")
def wildcard_filter(spark, sf_dir):
    """FLT-01..FLT-03"""
    p = load(spark, sf_dir, "part")
    return p.filter(P.matches(F.col("p_name"), "RED*") & P.excludes(F.col("p_brand"), "Brand#3") & P.in_list(F.col("p_type"), "ECONOMY, STANDARD")).select("p_partkey")


@query("glob_filter", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '_ed %' OR regexp_full_match(p_brand, 'Brand#[12].')")
def glob_filter(spark, sf_dir):
    """FLT-10, FLT-11"""
    return load(spark, sf_dir, "part").filter(P.identity_glob([F.col("p_name"), F.col("p_brand")], ["?ed *", "brand#[12]?"], keep_if_none=True)).select("p_partkey", "p_name")


@query("regex_filter", "SELECT page_id FROM pages WHERE regexp_matches(url, '^(?:http://(th|st))')")
def regex_filter(spark, sf_dir):
    """FLT-04"""
    return load(spark, sf_dir, "pages").filter(P.regex_at_start(F.col("url"), "http://(th|st)")).select("page_id")


@query("range_filter", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN TIMESTAMP '1997-05-01' AND TIMESTAMP '1997-05-31' OR o_orderdate BETWEEN TIMESTAMP '1997-05-01' AND TIMESTAMP '1997-05-31'")
def range_filter(spark, sf_dir):
    """FLT-05, FLT-06"""
    j = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.filter(P.any_in_range([F.col("l_shipdate"), F.col("o_orderdate")], day(1997, 5, 1), day(1997, 5, 31))).select("l_orderkey", "l_linenumber")


@query("period_filter", "SELECT event_id, keep_null FROM (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN ts END AS t FROM events), (SELECT unnest([true, false]) AS keep_null) WHERE t BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06' OR (keep_null AND t IS NULL)")
def period_filter(spark, sf_dir):
    """FLT-08, FLT-09"""
    e = events(spark, sf_dir).withColumn("t", F.when(F.col("event_id") % 10 != 0, F.col("ts")))
    a, b = day(2024, 1, 5), day(2024, 1, 6)
    return e.filter(P.in_period(F.col("t"), a, b, True)).select("event_id", F.lit(True).alias("keep_null")).unionByName(e.filter(P.in_period(F.col("t"), a, b)).select("event_id", F.lit(False).alias("keep_null")))


@query("filter_statistics", "SELECT event_type AS source, count(*) AS before, count(*) FILTER (value > 50) AS after, count(*) - count(*) FILTER (value > 50) AS removed FROM events GROUP BY 1")
def filter_statistics(spark, sf_dir):
    """FLT-12"""
    return P.filter_statistics(events(spark, sf_dir), P.no(F.col("value") > 50), "source")


@query("rule_conditions", "SELECT event_id FROM events WHERE lower(event_type) = 'click' AND value > 10 AND contains(props, '7') OR (event_type = 'error' AND user_id IN (1, 2, 3))")
def rule_conditions(spark, sf_dir):
    """FLT-13..FLT-15, RL-17"""
    a = P.conditions([{"field": "source", "operator": "equals", "value": "CLICK"}, {"field": "value", "operator": ">", "value": 10}, {"field": "props", "operator": "contains", "value": "7"}])
    b = P.conditions([{"field": "source", "operator": "regex", "value": "^err"}, {"field": "user_id", "operator": "in", "value": "1,2,3"}])
    return events(spark, sf_dir).filter(P.any_of([a, b])).select("event_id")


@query("journal_filters", "SELECT o_orderkey, o_orderstatus = 'F' AS deleted, o_orderstatus = 'O' AS created, o_custkey & 1 = 0 OR o_orderstatus = 'F' AS gone FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def journal_filters(spark, sf_dir):
    """FLT-17..FLT-19"""
    o = load(spark, sf_dir, "orders").filter(P.score_band(F.col("o_totalprice"), 100_000, 200_000))
    r = F.when(F.col("o_orderstatus") == "F", "FILE_DELETE|CLOSE").when(F.col("o_orderstatus") == "O", "FILE_CREATE").otherwise("RENAME_NEW_NAME")
    return o.select("o_orderkey", P.is_deleted_event(r).alias("deleted"), P.is_created_event(r).alias("created"), P.is_deleted_joined(F.col("o_custkey"), r).alias("gone"))


@query("times_disagree", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) > 86400000000 * 2000")
def times_disagree(spark, sf_dir):
    """FLT-20"""
    j = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.filter(P.times_disagree(F.col("l_shipdate"), F.col("o_orderdate"), 2000 * 86_400)).select("l_orderkey", "l_linenumber")


# rules and dictionaries

RULES = rules.rules_of([
    {"rule_id": "r1", "label": "Big click", "conditions": [{"field": "source", "value": "click"}, {"field": "value", "operator": ">", "value": 80}]},
    {"rule_id": "r2", "label": "Trouble", "logic": "OR", "conditions": [{"field": "source", "value": "error"}, {"field": "value", "operator": "<", "value": 1}]},
    {"rule_id": "r3", "label": "Key 7", "conditions": [{"field": "props", "operator": "regex", "value": ": 7[0-9]?}"}]},
    {"rule_id": "r4", "label": "Two of three", "logic": "OR", "min_indicators": 2, "conditions": [{"field": "source", "value": "purchase"}, {"field": "value", "operator": ">=", "value": 90}, {"field": "props", "operator": "contains", "value": "99"}]},
])
RULE_SQL = "[CASE WHEN event_type = 'click' AND value > 80 THEN 'r1' END, CASE WHEN event_type = 'error' OR value < 1 THEN 'r2' END, CASE WHEN regexp_matches(props, ': 7[0-9]?}') THEN 'r3' END, CASE WHEN (event_type = 'purchase')::INT + (value >= 90)::INT + contains(props, '99')::INT >= 2 THEN 'r4' END]"


@query("rule_tags", f"SELECT event_id, array_to_string(list_filter({RULE_SQL}, lambda x: x IS NOT NULL), ',') AS rule_ids FROM events")
def rule_tags(spark, sf_dir):
    """RL-03"""
    return rules.tag_rows(events(spark, sf_dir), RULES).select("event_id", F.array_join("rule_ids", ",").alias("rule_ids"))


IND = """
i AS (SELECT user_id, ts::DATE AS day, max((event_type = 'click')::INT) AS c1, max((value > 80)::INT) AS c2, max((event_type = 'error')::INT) AS c3, max((value < 1)::INT) AS c4, max(regexp_matches(props, ': 7[0-9]?}')::INT) AS c5, max((event_type = 'purchase')::INT) AS c6, max((value >= 90)::INT) AS c7, max(contains(props, '99')::INT) AS c8 FROM events GROUP BY ALL),
m AS (SELECT user_id, day, unnest(['r1', 'r2', 'r3', 'r4']) AS rule_id, unnest([c1 + c2, c3 + c4, c5, c6 + c7 + c8]) AS matched, unnest([2, 2, 1, 3]) AS total, unnest([2, 1, 1, 2]) AS need FROM i)"""


def indicators(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("src", F.col("source"))
    f = rules.long_fields(e.withColumnRenamed("src", "__s"), ["user_id", "day", "__s"], ["source", "value", "props"]).withColumnRenamed("__s", "source")
    return rules.match_indicators(f, ["user_id", "day"], RULES)


@query("rule_min_indicators", f"WITH {IND} SELECT user_id, day, rule_id, matched::INTEGER AS matched, total FROM m WHERE matched > 0")
def rule_min_indicators(spark, sf_dir):
    """RL-02, RL-04, RL-07: conditions met by any record of a user's day"""
    return indicators(spark, sf_dir).select("user_id", "day", "rule_id", F.col("matched").cast("int").alias("matched"), "total")


@query("match_tags", f"WITH {IND} SELECT user_id, day, string_agg(rule_id, ',' ORDER BY rule_id) AS rule_ids, count(*) AS n_rules FROM m WHERE matched >= need GROUP BY ALL")
def match_tags(spark, sf_dir):
    """RL-06, RL-10, RL-12"""
    return rules.tag_list(rules.matched_rules(indicators(spark, sf_dir), RULES), ["user_id", "day"])


@query("semantic_data", f"WITH {IND} SELECT user_id, day, string_agg(CASE rule_id WHEN 'r1' THEN 'Big click' WHEN 'r2' THEN 'Trouble' WHEN 'r3' THEN 'Key 7' ELSE 'Two of three' END, ',' ORDER BY rule_id) AS labels FROM m WHERE matched >= need GROUP BY ALL")
def semantic_data(spark, sf_dir):
    """RL-10"""
    d = rules.semantic_data(rules.matched_rules(indicators(spark, sf_dir), RULES), RULES, ["user_id", "day"])
    return d.select("user_id", "day", F.array_join(F.transform(F.map_values("semantic_data"), lambda v: v["label"]), ",").alias("labels"))


@query("broad_patterns", f"WITH {IND} SELECT rule_id, count(DISTINCT day) AS n_matches, count(DISTINCT day) > 100 AS too_broad FROM m WHERE matched >= need GROUP BY 1")
def broad_patterns(spark, sf_dir):
    """RL-08"""
    return rules.broad_patterns(rules.matched_rules(indicators(spark, sf_dir), RULES), "day")


@query("token_prefilter", r"SELECT doc_id FROM documents WHERE list_has_any(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), ['password', 'license'])")
def token_prefilter(spark, sf_dir):
    """RL-09: by whole tokens"""
    return rules.token_filter(load(spark, sf_dir, "documents"), F.col("text"), ["password", "license"]).select("doc_id")


PREFILTER_RULES = rules.rules_of([
    {"rule_id": "inner", "label": "Inside words", "conditions": [{"field": "text", "operator": "contains", "value": "icens"}, {"field": "source", "operator": "regex", "value": "src1|src7"}]},
    {"rule_id": "either", "label": "Either", "logic": "OR", "conditions": [{"field": "text", "operator": "contains", "value": "Passwor"}, {"field": "text", "operator": "regex", "value": "akia|secret_key"}]},
    {"rule_id": "two", "label": "Two of three", "logic": "OR", "min_indicators": 2, "conditions": [{"field": "text", "operator": "contains", "value": "token"}, {"field": "text", "operator": "contains", "value": "HTTP"}, {"field": "text", "operator": "contains", "value": "@"}]},
])
PREFILTER_SQL = """CASE WHEN contains(t, 'icens') AND regexp_matches(s, 'src1|src7') THEN 'inner' END, CASE WHEN contains(t, 'passwor') OR regexp_matches(t, 'akia|secret_key') THEN 'either' END,
  CASE WHEN contains(t, 'token')::INT + contains(t, 'http')::INT + contains(t, '@')::INT >= 2 THEN 'two' END"""


@query("exact_prefilter", f"""
WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s FROM documents),
r AS (SELECT doc_id, array_to_string(list_sort(list_filter([{PREFILTER_SQL}], lambda x: x IS NOT NULL)), ',') AS rule_ids FROM d)
SELECT doc_id, rule_ids FROM r WHERE rule_ids <> ''""")
def exact_prefilter(spark, sf_dir):
    """RL-09: the rules' rows by way of the gram index, rules of AND, OR and a least number"""
    docs = load(spark, sf_dir, "documents")
    index = gram_index.GramIndex.build(docs, "doc_id", ["text"])
    tagged = rules.tag_rows(index.prefilter(docs, PREFILTER_RULES), PREFILTER_RULES)
    return tagged.select("doc_id", F.array_join("rule_ids", ",").alias("rule_ids")).filter("rule_ids <> ''")


#: 1,200 rules whose conditions follow from their number, 3 to 80 each.
SOURCES = ("view", "click", "purchase", "signup", "error")
MANY_RULES = rules.rules_of([
    {"rule_id": f"r{n}", "label": "x", "logic": "AND" if n % 2 else "OR", "min_indicators": 1 + n % 3 if n % 2 == 0 else 1, "conditions": [
        {"field": "source", "operator": "equals", "value": SOURCES[n % 5].upper()}, {"field": "value", "operator": ">" if n % 4 < 2 else "<=", "value": n % 97}, {"field": "props", "operator": "contains", "value": f'": {n % 10}'},
        *[{"field": "user_id", "operator": "equals", "value": 1000 * n + i} for i in range(77) if n % 100 == 0]]}
    for n in range(1200)
])


@query("rule_index_tags", """
WITH h AS (
  SELECT e.event_id, r.n, (event_type = (['view', 'click', 'purchase', 'signup', 'error'])[r.n % 5 + 1])::INT + (CASE WHEN r.n % 4 < 2 THEN value > r.n % 97 ELSE value <= r.n % 97 END)::INT
    + contains(props, '": ' || (r.n % 10))::INT + (CASE WHEN r.n % 100 = 0 THEN (user_id BETWEEN 1000 * r.n AND 1000 * r.n + 76)::INT ELSE 0 END) AS met
  FROM events e, (SELECT unnest(range(1200)) AS n) r)
SELECT event_id, count(*) AS n_rules, min('r' || n) AS first_rule, max('r' || n) AS last_rule FROM h WHERE met >= CASE WHEN n % 2 = 1 THEN 3 ELSE 1 + n % 3 END GROUP BY event_id""")
def rule_index_tags(spark, sf_dir):
    """RL-03, RL-06: 1,200 rules through the index of predicates"""
    tagged = RuleIndex(spark, MANY_RULES).tag_rows(events(spark, sf_dir)).filter(F.size("rule_ids") > 0)
    return tagged.select("event_id", F.size("rule_ids").cast("long").alias("n_rules"), F.array_min("rule_ids").alias("first_rule"), F.array_max("rule_ids").alias("last_rule"))


MAPPINGS = [("source", "CLICK", "Interaction", 0.8, "global"), ("source", "click", "Tap", 0.9, "wing"), ("source", "error", "Failure", 1.0, "global"), ("source", "error", "Crash", 0.5, "pipeline")]


@query("semantic_labels", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Tap' WHEN 'error' THEN 'Failure' END AS label FROM events")
def semantic_labels(spark, sf_dir):
    """RL-01, RL-13, RL-18"""
    m = spark.createDataFrame(MAPPINGS, "field string, match_value string, label string, confidence double, scope string")
    f = rules.long_fields(events(spark, sf_dir), ["event_id"], ["source"])
    return rules.label_values(f, m).select("event_id", "label")


@query("pattern_labels", "SELECT doc_id, CASE WHEN source LIKE '%1' THEN 'ends in 1' WHEN source LIKE 'src%' THEN 'any' END AS label FROM documents")
def pattern_labels(spark, sf_dir):
    """RL-01 by patterns, the most confident first"""
    hits = rules.label_by_pattern(F.col("source"), [("^SRC", "any", 0.2), ("1$", "ends in 1", 0.9)])
    return load(spark, sf_dir, "documents").select("doc_id", F.get(hits, F.lit(0))["label"].alias("label"))


@query("scoped_labels", "SELECT DISTINCT event_type AS value, CASE event_type WHEN 'error' THEN 'Crash' WHEN 'click' THEN 'Tap' END AS label FROM events")
def scoped_labels(spark, sf_dir):
    """RL-05, RL-16"""
    m = spark.createDataFrame([(f, v, lab, s) for f, v, lab, _, s in MAPPINGS], "field string, value string, label string, scope string").withColumn("source", F.lit("events"))
    w = events(spark, sf_dir).groupBy(F.col("source").alias("value")).count().select(F.lit("events").alias("source"), F.lit("source").alias("field"), "value")
    return rules.scoped_value(w, m).select("value", "label")


@query("same_sources", "SELECT DISTINCT source, source LIKE 'src1%' AS same FROM documents")
def same_sources(spark, sf_dir):
    """RL-11"""
    return load(spark, sf_dir, "documents").groupBy("source").count().select("source", rules.same_source(F.col("source"), F.lit("SRC_1")).alias("same"))


@query("risk_levels", """
SELECT event_id, CASE event_type WHEN 'error' THEN 5 WHEN 'click' THEN 4 WHEN 'view' THEN 4 END AS severity, CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'click' THEN 'HIGH' WHEN 'view' THEN 'HIGH' END AS level,
  CASE event_type WHEN 'error' THEN 'tool_keyword' WHEN 'click' THEN 'suspicious_path' WHEN 'view' THEN 'temp_execution' END AS indicator FROM events""")
def risk_levels(spark, sf_dir):
    """RL-14: programs that start by themselves"""
    s = F.col("source")
    command = F.when(s == "error", "c:\\x\\Mimikatz.exe").when(s == "click", "C:\\Windows\\a.exe").when(s == "view", "d:\\attempt.exe").otherwise("d:\\a.exe")
    r = rules.start_risk(command)
    return events(spark, sf_dir).select("event_id", *[r[c].alias(c) for c in ("severity", "level", "indicator")])


@query("remote_names", "SELECT p_name AS found FROM part WHERE regexp_matches(p_name, '(?i)red|ring') UNION SELECT o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '(?i)red|ring')")
def remote_names(spark, sf_dir):
    """RL-15"""
    return rules.find_names([load(spark, sf_dir, "part").select(F.col("p_name").alias("n")), load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("n"))], "n", ["red", "ring"])


@query("dict_merge", """
WITH p AS (SELECT p_brand AS value, p_type AS key, 'part' AS source, 0 AS o FROM part UNION ALL SELECT c_mktsegment, c_nationkey::VARCHAR, 'customer', 1 FROM customer),
f AS (SELECT value, key, min(o) AS o, min(source) AS source FROM p GROUP BY ALL)
SELECT value, string_agg(key, ',' ORDER BY o, key) AS keys, arg_min(source, o) AS source FROM f GROUP BY value""")
def dict_merge(spark, sf_dir):
    """EN-01..EN-03"""
    t = {"part": load(spark, sf_dir, "part"), "customer": load(spark, sf_dir, "customer")}
    pairs = rules.dictionary_pairs(t, [rules.DictionaryRule("part", "p_brand", "p_type"), rules.DictionaryRule("customer", "c_mktsegment", "c_nationkey")])
    return rules.merge_dictionary(pairs)


# search


@query("search_rank", """
WITH r AS (SELECT 'part' AS table_name, p_partkey::VARCHAR AS row_id, CASE WHEN contains(lower(p_name), 'red') THEN 3.0::DOUBLE * CASE WHEN lower(p_name) = 'red' THEN 2 ELSE 1 END * CASE WHEN starts_with(lower(p_name), 'red') THEN 1.5::DOUBLE ELSE 1 END * 1.2::DOUBLE ELSE 0 END AS a, CASE WHEN contains(lower(p_type), 'red') THEN 1.2::DOUBLE * CASE WHEN starts_with(lower(p_type), 'red') THEN 1.5::DOUBLE ELSE 1 END ELSE 0 END AS b FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red'))
SELECT table_name, row_id, round((a + b) * CASE WHEN a > 0 AND b > 0 THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END, 6) AS relevance FROM r""")
def search_rank(spark, sf_dir):
    """SR-01..SR-04"""
    r = search.search_tables({"part": (load(spark, sf_dir, "part").withColumnRenamed("p_name", "name"), "p_partkey", ["name", "p_type"])}, "Red", cap=None)
    return r.select("table_name", "row_id", F.round("relevance", 6).alias("relevance"))


@query("search_suggestions", "SELECT DISTINCT p_name AS suggestion FROM part WHERE contains(lower(p_name), 'ing') ORDER BY 1 LIMIT 10")
def search_suggestions(spark, sf_dir):
    """SR-05: ten suggestions"""
    return search.suggestions(load(spark, sf_dir, "part"), "p_name", "ING", 10)


@query("time_search", "SELECT event_id FROM events WHERE contains(lower(props), '7') AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def time_search(spark, sf_dir):
    """SR-06"""
    return search.search_in_time(events(spark, sf_dir), ["props"], "7", [F.col("ts")], day(2024, 1, 10), day(2024, 1, 12)).select("event_id")


@query("text_search", r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)password')) FROM documents) GROUP BY 1")
def text_search(spark, sf_dir):
    """SR-07"""
    return search.find_in_text(load(spark, sf_dir, "documents"), "text", "password", "text", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("vector_topk", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], e) AS s FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS rank FROM s WHERE s > 0.2) SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM r WHERE rank <= 5""")
def vector_topk(spark, sf_dir):
    """SR-08: every twentieth row against all rows, the best five each with their similarity"""
    v = load(spark, sf_dir, "embeddings")
    return search.vector_topk(v, v.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5, 0.2).withColumn("similarity", F.round("similarity", 6))


@query("vector_topk_twentieth", """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], e) AS s FROM embeddings, q WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INTEGER AS rank FROM s WHERE s > 0.1) SELECT query_id, rank, vec_id FROM r WHERE rank <= 3""")
def vector_topk_twentieth(spark, sf_dir):
    """SR-08: every twentieth row against all rows, the best three each"""
    v = load(spark, sf_dir, "embeddings")
    return search.vector_topk(v, v.filter("vec_id % 20 = 0"), "vec_id", "embedding", 3, 0.1).select("query_id", "rank", "vec_id")


@query("chunks", r"WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS c, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS i FROM documents) SELECT doc_id, i::INTEGER AS chunk_no, length(trim(c))::INTEGER AS n FROM c WHERE length(trim(c)) > 50")
def chunks(spark, sf_dir):
    """SR-09"""
    return search.chunks(load(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_no", F.length("chunk").alias("n"))


# timeline

LANES = [timeline.Lane("order", "orders", "o_orderkey", (("o_orderdate", "ordered"),), name_col="o_orderpriority"), timeline.Lane("line", "lineitem", "l_orderkey", (("l_shipdate", "shipped"), ("received", "received")), path_col="l_returnflag")]


@query("unpivot_timeline", """
SELECT 'order' AS artifact, 'orders' AS source_table, o_orderkey AS row_id, o_orderpriority AS display_name, NULL AS full_path, o_orderdate AS ts, 'ordered' AS event_kind FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-02-01'
UNION ALL SELECT 'line', 'lineitem', l_orderkey, NULL, l_returnflag, l_shipdate, 'shipped' FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-02-01'
UNION ALL SELECT 'line', 'lineitem', l_orderkey, NULL, l_returnflag, l_shipdate + INTERVAL 7 DAY, 'received' FROM lineitem WHERE l_linenumber = 1 AND l_shipdate + INTERVAL 7 DAY BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-02-01'""")
def unpivot_timeline(spark, sf_dir):
    """TL-01..TL-05"""
    li = load(spark, sf_dir, "lineitem").withColumn("received", F.when(F.col("l_linenumber") == 1, F.expr("l_shipdate + interval 7 day")))
    return plain(timeline.timeline({"orders": load(spark, sf_dir, "orders"), "lineitem": li}, LANES, day(1998, 1, 1), day(1998, 2, 1)))


@query("timeline_json_times", "SELECT o_custkey AS row_id, o_orderdate AS ts, 'run' AS event_kind FROM orders")
def timeline_json_times(spark, sf_dir):
    """TL-01 with a JSON list of times"""
    o = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))).alias("runs"))
    lane = timeline.Lane("run", "o", "o_custkey", (), json_times=("runs", "run"))
    return plain(timeline.lane_events(o.withColumn("none", F.lit(None).cast("timestamp")), timeline.Lane("run", "o", "o_custkey", (("none", "none"),), json_times=lane.json_times)).select("row_id", "ts", "event_kind"))


@query("lane_numbers", "SELECT event_id AS row_id, round(value * 1024, 3) AS sent FROM events WHERE event_type = 'view'")
def lane_numbers(spark, sf_dir):
    """TL-06"""
    e = events(spark, sf_dir).select(F.col("source").alias("artifact"), F.col("event_id").alias("row_id"), F.concat(F.col("value").cast("string"), F.lit(" KB")).alias("sent"))
    return timeline.lane_view(e, "view", ["sent"]).select("row_id", F.round("sent", 3).alias("sent"))


@query("event_detail", "SELECT * FROM orders WHERE o_orderkey = 77")
def event_detail(spark, sf_dir):
    """TL-07"""
    return plain(timeline.event_detail(load(spark, sf_dir, "orders"), "o_orderkey", 77))


# sources and inference


@query("full_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def full_scan(spark, sf_dir):
    """SRC-01, SRC-02"""
    return io.view_of(io.read_table(spark, f"{sf_dir}/orders.parquet", equal={"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}), ["o_orderkey", "o_totalprice"])


@query("evidence_table", "SELECT 'erp' AS source_tool, o_orderdate AS primary_timestamp, 'order' AS artifact_type, 'orders' AS source_path, o_orderkey AS order_no, o_totalprice AS total_price, NULL::BIGINT AS priority FROM orders")
def evidence_table(spark, sf_dir):
    """SRC-07, SRC-08"""
    m = {"table": "orders", "columns": {"o_orderkey": ("order no", "bigint"), "o_totalprice": ("total-price", "double"), "o_orderpriority": ("priority", "bigint")}, "source_tool": "erp", "artifact_type": "order", "key": ["o_orderkey"], "event_time": F.col("o_orderdate")}
    return plain(io.build_evidence({"orders": load(spark, sf_dir, "orders")}, [m])["order"].drop("artifact_id", "collection_timestamp"))


@query("union_view", "SELECT 'nation' AS _source_table, n_name AS name, n_regionkey AS region, NULL AS r_name FROM nation UNION ALL SELECT 'region', NULL, r_regionkey, r_name FROM region")
def union_view(spark, sf_dir):
    """SRC-10"""
    n = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    r = load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"), "r_name")
    return io.union_view({"nation": n, "region": r})


@query("column_types", "SELECT * FROM (VALUES ('o_orderkey', 'INTEGER'), ('o_custkey', 'INTEGER'), ('o_orderstatus', 'TEXT'), ('o_totalprice', 'REAL'), ('o_orderdate', 'DATETIME'), ('o_orderpriority', 'TEXT')) t(\"column\", type)")
def column_types(spark, sf_dir):
    """SRC-11"""
    o = load(spark, sf_dir, "orders")
    return io.column_types(o.select(*[F.col(c).cast("string").alias(c) for c in o.columns]))


@query("typed_values", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS q, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity::INTEGER::VARCHAR ELSE 'x' || l_quantity::INTEGER::VARCHAR END AS q_raw FROM lineitem")
def typed_values(spark, sf_dir):
    """SRC-12: every other value can't be cast and stays as text"""
    q = F.col("l_quantity").cast("int").cast("string")
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, q).otherwise(F.concat(F.lit("x"), q)).alias("q"))
    return io.typed(d, {"q": "REAL"})


@query("row_validation", "SELECT l_orderkey, l_linenumber, 'q:not REAL' AS errors FROM lineitem WHERE l_linenumber % 2 = 1 UNION ALL SELECT l_orderkey, l_linenumber, 'flag:missing' FROM lineitem WHERE l_linenumber % 2 = 0 AND l_returnflag = 'R'")
def row_validation(spark, sf_dir):
    """SRC-13"""
    q = F.col("l_quantity").cast("string")
    d = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, q).otherwise(F.concat(F.lit("x"), q)).alias("q"), F.when((F.col("l_returnflag") != "R") | (F.col("l_linenumber") % 2 == 1), F.col("l_returnflag")).alias("flag"))
    bad = io.validated(d, {"q": "REAL"}, ["flag"])[1]
    return bad.select("l_orderkey", "l_linenumber", F.array_join(F.transform("errors", lambda e: F.concat(e["column"], F.lit(":"), e["error"])), ",").alias("errors"))


@query("trimmed_rows", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def trimmed_rows(spark, sf_dir):
    """SRC-14"""
    c = load(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), F.concat("c_mktsegment", F.lit("  ")).alias("c_mktsegment"))
    return io.trimmed(c)


@query("table_statistics", "SELECT count(*) AS n_rows, 3 AS n_columns, count(doc_id) AS n_doc_id, count(lang) AS n_lang, count(source) AS n_source FROM documents")
def table_statistics(spark, sf_dir):
    """SRC-15"""
    return io.table_statistics(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"))


@query("indicator_pairs", "SELECT p_brand AS value, p_type AS key, 'ioc' AS source, count(*) AS n FROM part WHERE p_partkey % 4 <> 0 GROUP BY ALL")
def indicator_pairs(spark, sf_dir):
    """SRC-16: every fourth value is blank"""
    p = load(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 4 != 0, F.col("p_brand")).otherwise(" ").alias("v"), "p_type")
    return io.indicator_pairs(p, "v", "p_type", "ioc").groupBy("value", "key", "source").agg(F.count(F.lit(1)).alias("n"))


@query("time_columns", "SELECT 'o_orderdate' AS \"column\", 1.0::DOUBLE AS rate, 'sql' AS format")
def time_columns(spark, sf_dir):
    """INF-03: the sample of 100 rows is the feature"""
    return infer.time_columns(load(spark, sf_dir, "orders"))


@query("any_time_columns", "SELECT 'ts' AS \"column\", 1.0::DOUBLE AS rate")
def any_time_columns(spark, sf_dir):
    """INF-04"""
    return infer.any_time_columns(load(spark, sf_dir, "events").select("ts", "event_type", "props"))


@query("priority_time_columns", "SELECT 'l_shipdate' AS \"column\", 0 AS rank, 1.0::DOUBLE AS rate UNION ALL SELECT 'received_time', 1, 1.0::DOUBLE")
def priority_time_columns(spark, sf_dir):
    """INF-05"""
    li = load(spark, sf_dir, "lineitem").withColumn("received_time", F.col("l_shipdate"))
    return infer.priority_time_columns(li, ["shipdate", "time", "linestatus"])


@query("artifact_types", """
SELECT source, CASE WHEN source = 'src1' THEN 'Link' WHEN source LIKE '%2%' THEN 'Journal' ELSE 'Table' END AS type, CASE WHEN source = 'src1' THEN 0.9::DOUBLE WHEN source LIKE '%2%' THEN 0.7::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM (SELECT DISTINCT source FROM documents)""")
def artifact_types(spark, sf_dir):
    """INF-06..INF-10: sources as tables, their columns and file names"""
    s = F.col("source")
    d = load(spark, sf_dir, "documents").groupBy("source").count()
    by_columns = infer.type_by_columns(F.array(F.lit("Doc_id"), F.lit("text")), {"Table": ["doc_id", "text"], "Other": ["x"]})
    got = infer.combined_type(F.lit(None).cast("string"), infer.type_by_table(s, {"SRC1": "Link"}, {"2": "Journal"}), infer.type_by_file(F.concat(F.lit("/x/"), s), {"zzz": "Other"}), by_columns)
    return d.select("source", got["type"].alias("type"), got["confidence"].alias("confidence"))


@query("types_by_suffix", "SELECT source, CASE WHEN source LIKE '%9' THEN 'nine' ELSE 'Unknown' END AS type FROM (SELECT DISTINCT source FROM documents)")
def types_by_suffix(spark, sf_dir):
    """INF-09"""
    return load(spark, sf_dir, "documents").groupBy("source").count().select("source", infer.type_by_suffix(F.col("source"), [("9$", "nine")]).alias("type"))
