"""Search (SR-01..SR-09) and result queries (QRY-01..07)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.predicates import like_of
from evspark.operators import cosine

# Weights of columns in relevance; any other counts 1.
COLUMN_WEIGHTS = {"filename": 3.0, "name": 3.0, "file_name": 3.0, "path": 2.0, "full_path": 2.0, "reconstructed_path": 2.0, "description": 1.5, "content": 1.5}


def hit(column: str, term: str, case: bool = False, exact: bool = False) -> Column:
    x = F.col(column).cast("string")
    x, t = (x, term) if case else (F.lower(x), term.lower())
    return F.coalesce(x == t if exact else x.contains(t), F.lit(False))


def matched_columns(columns: list[str], term: str, case: bool = False, exact: bool = False) -> Column:
    """SR-03"""
    return F.filter(F.array(*[F.when(hit(c, term, case, exact), F.lit(c)) for c in columns]), lambda c: c.isNotNull())


def search_table(df: DataFrame, columns: list[str], term: str, case: bool = False, exact: bool = False) -> DataFrame:
    """SR-01: rows in which any of the columns has the term, with the list of those columns."""
    any_hit = reduce(lambda a, b: a | b, [hit(c, term, case, exact) for c in columns])
    return df.filter(any_hit).withColumn("matched_columns", matched_columns(columns, term, case, exact))


def relevance(columns: list[str], term: str, case: bool = False, weights: dict[str, float] | None = None) -> Column:
    """SR-04: column weights; whole value doubles, a prefix counts 1.5, a short value 1.2; several columns more."""
    weights = {**COLUMN_WEIGHTS, **(weights or {})}
    parts, n = [], F.lit(0)
    for c in columns:
        x = F.col(c).cast("string")
        v, t = (x, term) if case else (F.lower(x), term.lower())
        s = F.lit(weights.get(c.lower(), 1.0)) * F.when(v == t, 2.0).otherwise(1.0) * F.when(v.startswith(t), 1.5).otherwise(1.0) * F.when(F.length(x) < 50, 1.2).otherwise(1.0)
        parts.append(F.when(hit(c, term, case), s).otherwise(0.0))
        n = n + hit(c, term, case).cast("int")
    return reduce(lambda a, b: a + b, parts) * F.when(n > 1, F.lit(1.0) + F.lit(0.1) * (n - 1)).otherwise(1.0)


def search_tables(tables: dict[str, tuple[DataFrame, str, list[str]]], term: str, case: bool = False, cap: int | None = 100) -> DataFrame:
    """SR-02: table, row_id, matched_columns, relevance over many tables: name -> (table, id column, columns). The cap a
    table is the report's size; None lifts it."""
    parts = []
    for name, (df, id_col, columns) in tables.items():
        r = search_table(df, columns, term, case).select(F.lit(name).alias("table_name"), F.col(id_col).cast("string").alias("row_id"), "matched_columns", relevance(columns, term, case).alias("relevance"))
        parts.append(r.orderBy(F.col("relevance").desc(), "row_id").limit(cap) if cap else r)
    return reduce(lambda a, b: a.unionByName(b), parts)


def suggestions(df: DataFrame, column: str, term: str, k: int = 10) -> DataFrame:
    """SR-05: distinct values with the term (a report of k)."""
    return df.filter(hit(column, term)).select(F.col(column).alias("suggestion")).distinct().orderBy("suggestion").limit(k)


def search_in_time(df: DataFrame, columns: list[str], term: str, times: list[Column], lo, hi) -> DataFrame:
    """SR-06: the term first, then any of the times in the range; nothing is cut before both held."""
    return search_table(df, columns, term).filter(F.exists(F.array(*times), lambda t: F.coalesce(t.between(F.lit(lo), F.lit(hi)), F.lit(False))))


# A word's edge, spelt out: letters, numbers and underscores of all scripts, which engines' own \\b don't agree on.
_W = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def find_in_text(df: DataFrame, column: str, pattern: str, mode: str = "text", id_col: str = "id") -> DataFrame:
    """SR-07: id, place (from 1), found, start, end (code points, end exclusive): every occurrence by text, whole word or
    regex; texts without one drop out. A regex that finds empty strings has null for start and end."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in pattern)
    # a word's letters are looked at first, since its edges cost more
    p = {"text": f"(?i){quoted}", "word": rf"(?i)(?={quoted}){EDGE}{quoted}{EDGE}", "regex": f"(?i){pattern}"}[mode]
    rows = df.filter(F.coalesce(F.col(column).rlike(p), F.lit(False)))
    found = F.regexp_extract_all(column, F.lit(p), F.lit(0))
    # each with what stands before it; bound to the end of the one before (\G), so that what follows the last one is read once
    upto = F.regexp_extract_all(column, F.lit(rf"\G[\s\S]*?(?:{p})"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("ends"))
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["ends"], F.array(s["at"] + F.length(x))).alias("ends"))
    ends = F.when((F.size(found) == F.size(upto)) & ~F.array_contains(found, ""), F.aggregate(upto, zero, step)["ends"])
    hits = rows.select(id_col, F.posexplode(F.arrays_zip(found.alias("found"), F.coalesce(ends, F.expr("cast(array() as array<int>)")).alias("end"))).alias("pos", "hit"))
    end = F.col("hit.end")
    return hits.select(id_col, (F.col("pos") + 1).alias("place"), F.col("hit.found").alias("found"), (end - F.length("hit.found")).alias("start"), end.alias("end"))


# Words that make a query semantic, signs that make it a pattern, forms of time in a query.
SEMANTIC_WORDS = ("execution", "access", "network", "registry", "file", "process")
PATTERN_SIGNS = "[]()*+?^$"
TIME_FORMS = r"\d{4}-\d{2}-\d{2}|\d{2}:\d{2}|today|yesterday|last\s+\w+"


def search_mode(query: str) -> str:
    """SR-07: temporal, pattern, semantic or text, by what the query looks like."""
    if re.search(TIME_FORMS, query, re.I):
        return "temporal"
    if any(c in query for c in PATTERN_SIGNS):
        return "pattern"
    return "semantic" if any(w in query.lower() for w in SEMANTIC_WORDS) else "text"


def time_matches(query: str, ts: Column, now: Column) -> Column:
    """SR-07: whether an instant fits a temporal query: today, yesterday, last hour, last day, or any date or hour:minute
    that it names."""
    q, t = query.lower(), ts.cast("timestamp")
    if "today" in q:
        return F.to_date(t) == F.to_date(now)
    if "yesterday" in q:
        return F.to_date(t) == F.date_sub(F.to_date(now), 1)
    if "last hour" in q or "last day" in q:
        return t > now - F.expr("interval 1 hour" if "last hour" in q else "interval 1 day")
    said = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    parts = [*re.findall(r"\d{4}-\d{2}-\d{2}", query), *re.findall(r"\d{2}:\d{2}", query)]
    return reduce(lambda a, b: a | b, [said.contains(p) for p in parts], F.lit(False))


def find_results(rows: DataFrame, query: str, id_col: str, ts: str, texts: list[str], semantic: str | None = None, categories: list[str] | None = None, mode: str | None = None, now: Column | None = None, confidence: Column | None = None, least: float = 0.0, whole_words: bool = False) -> DataFrame:
    """SR-07: id, ts, match_type, context, match_text, start, end, confidence of every hit, surest first, then by time.

    Text and patterns are looked for in `texts`, semantic queries in the values of the map column `semantic` (of some
    categories where asked for), temporal ones in `ts`. The mode follows from the query unless it is given; `combined`
    looks in texts and semantics. A hit is as sure as its row's `confidence`, 1 where there is none.
    """
    mode = mode or search_mode(query)
    sure = F.coalesce(confidence, F.lit(1.0)) if confidence is not None else F.lit(1.0)
    base = rows.select(F.col(id_col).alias("id"), F.col(ts).alias("ts"), sure.cast("double").alias("confidence"), *texts, *([semantic] if semantic else []))
    if mode == "temporal":
        hit = base.filter(time_matches(query, F.col("ts"), now if now is not None else F.current_timestamp()))
        none = F.lit(None).cast("int")
        found = hit.select("id", "ts", F.lit("Timestamp").alias("context"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("match_text"), none.alias("start"), none.alias("end"), "confidence")
    else:
        pairs = [F.struct(F.lit(f"Data {c}").alias("context"), F.col(c).cast("string").alias("value")) for c in texts] if mode != "semantic" else []
        every = F.array(*pairs) if pairs else F.expr("cast(array() as array<struct<context: string, value: string>>)")
        if semantic and mode in ("semantic", "combined"):
            chosen = F.map_filter(semantic, lambda k, v: k.isin(categories)) if categories else F.col(semantic)
            of = F.transform(F.map_entries(chosen), lambda e: F.struct(F.concat(F.lit("Semantic "), e["key"]).alias("context"), e["value"].cast("string").alias("value")))
            every = F.concat(every, F.coalesce(of, F.expr("cast(array() as array<struct<context: string, value: string>>)")))
        long = base.select("id", "ts", "confidence", F.explode(F.filter(every, lambda p: p["value"].isNotNull())).alias("p")).select(F.struct("id", "ts", "confidence", "p.context").alias("row"), "p.value")
        kind = "regex" if mode == "pattern" else "word" if whole_words else "text"
        found = find_in_text(long, "value", query, kind, "row").select("row.id", "row.ts", "row.context", F.col("found").alias("match_text"), "start", "end", "row.confidence")
    found = found.withColumn("match_type", F.lit(mode))
    return found.filter(F.col("confidence") >= least).orderBy(F.col("confidence").desc(), "ts", "id", "context", "start")


def vector_topk(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 3, least: float = 0.4, most_queries: int = 256) -> DataFrame:
    """SR-08: query_id, rank, id, similarity: the k most similar vectors above a bound, for any number of queries, of
    which a task meets `most_queries` at once (cosine.best)."""
    return cosine.best(vectors, queries, id_col, vec_col, k, least, chunk=most_queries)


def chunks(df: DataFrame, id_col: str, text: str, least: int = 50) -> DataFrame:
    """SR-09: pieces between blank lines that are longer than 50 characters, with their place."""
    p = df.select(id_col, F.posexplode(F.split(F.col(text), "\n\n"))).select(id_col, F.col("pos").alias("chunk_no"), F.trim(F.col("col")).alias("chunk"))
    return p.filter(F.length("chunk") > least)


# result queries


def page(df: DataFrame, order: list[Column | str], number: int, size: int, first: int = 1) -> DataFrame:
    """SRC-03, QRY-02: one page of an ordered table; pages count from `first`."""
    return df.orderBy(*order).offset((number - first) * size).limit(size)


def page_facts(df: DataFrame, number: int, size: int) -> DataFrame:
    """SRC-03: total_count, total_pages, has_next, has_prev for 1-based pages."""
    return df.agg(F.count(F.lit(1)).alias("total_count")).withColumn("total_pages", F.ceil(F.col("total_count") / size)).withColumn("has_next", F.col("total_pages") > number).withColumn("has_prev", F.lit(number > 1))


def matches_by(df: DataFrame, score: float | None = None, sources: int | None = None, app: str | None = None) -> DataFrame:
    """QRY-01"""
    if score is not None:
        df = df.filter(F.col("score") >= score)
    if sources is not None:
        df = df.filter(F.col("n_sources") >= sources)
    return df.filter(F.lower("app") == app.lower()) if app is not None else df


def identities(df: DataFrame, kind: str | None = None, value: str | None = None, kind_col: str = "identity_type", value_col: str = "identity_value", seen: str = "first_seen") -> DataFrame:
    """QRY-02: type equal, value like a wildcard, by first seen."""
    if kind:
        df = df.filter(F.col(kind_col) == kind)
    if value:
        df = df.filter(F.coalesce(F.col(value_col).ilike(like_of(value)), F.lit(False)))
    return df.orderBy(seen, value_col)


def anchor_times(anchors: DataFrame, start: str, lo, hi) -> DataFrame:
    """QRY-04"""
    return anchors.filter(F.col(start).between(F.lit(lo), F.lit(hi))).select(start).distinct().orderBy(start)


def executions(df: DataFrame, lo=None, hi=None, engine: str | None = None, name: str | None = None, k: int | None = None) -> DataFrame:
    """QRY-05, QRY-07: run history, latest first."""
    if lo is not None:
        df = df.filter(F.col("run_ts").between(F.lit(lo), F.lit(hi)))
    if engine:
        df = df.filter(F.col("engine") == engine)
    if name:
        df = df.filter(F.coalesce(F.col("pipeline_name").ilike(like_of(f"*{name}*")), F.lit(False)))
    df = df.orderBy(F.col("run_ts").desc(), F.col("execution_id").desc())
    return df.limit(k) if k else df


def groups_by(groups: DataFrame, by: str = "activity", lo=None, hi=None) -> DataFrame:
    """QRY-03, QRY-06: groups of anchors by evidence or by time."""
    if lo is not None:
        groups = groups.filter(F.col("group_start").between(F.lit(lo), F.lit(hi)))
    return groups.orderBy(F.col("n_evidence").desc(), "group_start") if by == "activity" else groups.orderBy("group_start")


def matches_of(matches: DataFrame, result_id=None, match_id=None, k: int | None = None) -> DataFrame:
    """QRY-07: matches of a result in time order, or one match."""
    if match_id is not None:
        return matches.filter(F.col("match_id") == match_id)
    df = matches.filter(F.col("result_id") == result_id).orderBy("match_ts", "match_id")
    return df.limit(k) if k else df
