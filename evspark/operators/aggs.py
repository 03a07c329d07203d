"""Aggregations (AG-01..AG-41) and set comparison (ST-01..ST-03)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.operators.joins import US, config_table, us
from evspark.storage import written

# The sizes a timeline can be cut by, in seconds.
BUCKETS = {"minute": 60, "5min": 300, "15min": 900, "30min": 1800, "hour": 3600, "6hour": 21_600, "12hour": 43_200, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}


def bucket_size(span_s: float, target: int = 100) -> str:
    """AG-01 `auto`: the size nearest to span / target, for a span measured by one aggregate."""
    return min(BUCKETS, key=lambda k: (abs(BUCKETS[k] - span_s / target), BUCKETS[k]))


def bucket_counts(df: DataFrame, ts: str, kind: str, size: str | int, id_col: str | None = None) -> DataFrame:
    """AG-01: total and counts by kind (a map) for each epoch-floored bucket; ids only where asked for, all of a bucket's in
    one array (for buckets of any size see expand_bucket)."""
    width = (BUCKETS[size] if isinstance(size, str) else size) * US
    key = (F.floor(us(ts) / width) * width).alias("b")
    per = df.filter(F.col(ts).isNotNull()).groupBy(key, F.col(kind).alias("k")).agg(F.count(F.lit(1)).alias("n"), *([F.array_sort(F.collect_list(id_col)).alias("ids")] if id_col else []))
    more = [F.array_sort(F.flatten(F.collect_list("ids"))).alias("event_ids")] if id_col else []
    return per.groupBy("b").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("by_kind"), *more).withColumn("bucket_ts", F.timestamp_micros("b")).drop("b")


def expand_bucket(buckets: DataFrame, events: DataFrame, ts: str, size: str | int) -> DataFrame:
    """AG-03: the events of some buckets, met by the bucket each event lies in; no bucket's ids are gathered."""
    width = (BUCKETS[size] if isinstance(size, str) else size) * US
    return events.withColumn("bucket_ts", F.timestamp_micros((F.floor(us(ts) / width) * width).cast("long"))).join(buckets.select("bucket_ts"), "bucket_ts", "left_semi")


def heat(df: DataFrame, source: str, ts: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """AG-04: counts (and sums) by source, day and hour. AG-05: partial sums of several tables are the same call on
    their union; Spark adds partial sums before the shuffle."""
    t = F.col(ts).cast("timestamp")
    return df.filter(F.col(ts).isNotNull()).groupBy(F.col(source).alias("source"), F.to_date(t).alias("day"), F.hour(t).alias("hour")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in (sums or {}).items()])


def resum(parts: list[DataFrame], keys: list[str], sums: list[str]) -> DataFrame:
    """AG-05: pre-aggregates of several tables, united and summed again."""
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def bounds(df: DataFrame, columns: list[str], least: str = "2000-01-01") -> DataFrame:
    """AG-06: first and last instant over several columns; instants before `least` don't count."""
    every = df.select(F.explode(F.array(*[F.col(c).cast("timestamp") for c in columns])).alias("t")).filter(F.col("t") >= F.lit(least).cast("timestamp"))
    return every.agg(F.min("t").alias("first_ts"), F.max("t").alias("last_ts"))


def robust_range(df: DataFrame, key: list[str], ts: str, low: bool = True, high: bool = True, years: int = 20, least: int = 4, slice_seconds: int = 86_400) -> DataFrame:
    """AG-07: range of each source without outliers: beyond 1.5 IQR (quartiles by nearest rank, n/4 and 3n/4), or over
    20 years before the latest; groups of under 4 keep all.

    Counts by time slice, one row a slice, tell in which slice a quartile lies; only the rows of that slice are ranked.
    So a source of any size is summed before it shuffles, and no task orders more than a slice of it. Tables of one or
    two rows a source are broadcast behind a count.
    """
    t = df.filter(F.col(ts).isNotNull()).select(*key, us(ts).alias("t")).withColumn("slice", F.floor(F.col("t") / (slice_seconds * US)))
    by = Window.partitionBy(*key)
    per = t.groupBy(*key, "slice").agg(F.count(F.lit(1)).alias("c"), F.max("t").alias("hi"))
    per = per.withColumn("upto", F.sum("c").over(by.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by)).withColumn("latest", F.max("hi").over(by))
    per = per.withColumn("i1", F.floor(F.col("n") / 4)).withColumn("i3", F.floor(F.col("n") * 3 / 4)).withColumn("before", F.col("upto") - F.col("c"))
    lies = lambda i: (F.col("before") <= F.col(i)) & (F.col(i) < F.col("upto"))
    slices = config_table(written(per.filter(lies("i1") | lies("i3")).select(*[F.col(k).alias(f"s_{k}") for k in key], F.col("slice").alias("s_slice"), "before", "upto", "i1", "i3", "n", "latest")))
    same = lambda p: reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{p}{k}")) for k in key], F.lit(True))
    inside = t.join(slices, same("s_") & (F.col("slice") == F.col("s_slice"))).groupBy(*key, "slice", "t", "before", "upto", "i1", "i3", "n", "latest").agg(F.count(F.lit(1)).alias("c"))
    place = F.col("before") + F.sum("c").over(Window.partitionBy(*key, "slice").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("place", place)
    at = lambda i: F.min(F.when(lies(i) & (F.col("place") > F.col(i)), F.col("t")))
    facts = inside.groupBy(*key).agg(at("i1").alias("q1"), at("i3").alias("q3"), F.max("n").alias("n"), F.max("latest").alias("latest"))
    facts = config_table(written(facts.select(*[F.col(k).alias(f"f_{k}") for k in key], "q1", "q3", "n", "latest")))
    reach = (F.col("q3") - F.col("q1")) * F.lit(1.5)
    out_low = ((F.col("t") < F.col("q1") - reach) | (F.col("t") < F.col("latest") - F.lit(years * 365 * 86_400 * US))) if low else F.lit(False)
    out_high = (F.col("t") > F.col("q3") + reach) if high else F.lit(False)
    kept = t.join(facts, same("f_")).withColumn("out", (F.col("n") >= least) & (out_low | out_high))
    return kept.groupBy(*key).agg(F.timestamp_micros(F.min(F.when(~F.col("out"), F.col("t")))).alias("first_ts"), F.timestamp_micros(F.max(F.when(~F.col("out"), F.col("t")))).alias("last_ts"), F.count_if("out").alias("n_outliers"))


def breakdown(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """AG-09, AG-19: rows of each value, most first."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), key)


def span_statistics(df: DataFrame, ts: str, identity: str) -> DataFrame:
    """AG-10, AG-13"""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), ((us(F.max(F.col(ts).cast("timestamp"))) - us(F.min(F.col(ts).cast("timestamp")))) / F.lit(float(US))).alias("span_s"), F.count_distinct(identity).alias("n_identities"), F.count(F.lit(1)).alias("n_rows"))


def role_statistics(anchors: DataFrame, evidence: DataFrame, key: str, at: list[str], identity: str, role: str, roles: list[str]) -> DataFrame:
    """AG-11: for each anchor time: distinct identities, evidence rows, and rows of each role; anchors without count too."""
    per = evidence.groupBy(key).agg(F.count(F.lit(1)).alias("n_evidence"), *[F.count_if(F.col(role) == r).alias(f"n_{r.lower()}") for r in roles])
    j = anchors.join(per, key, "left")
    return j.groupBy(*at).agg(F.count_distinct(identity).alias("n_identities"), F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("n_evidence"), *[F.coalesce(F.sum(f"n_{r.lower()}"), F.lit(0)).alias(f"n_{r.lower()}") for r in roles])


def top_per(df: DataFrame, key: list[str], value: str, k: int = 10) -> DataFrame:
    """AG-12: the k most frequent values of each key."""
    n = df.groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*key).orderBy(F.col("n").desc(), value)
    return n.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def run_statistics(matches: DataFrame, run: str, app: str, ts: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """AG-14: totals, and the k applications with most matches (a report)."""
    return matches.agg(F.count(F.lit(1)).alias("n_matches"), F.count_distinct(run).alias("n_runs"), F.max(run).alias("latest_run"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")), breakdown(matches, app).limit(k)


def journal_statistics(df: DataFrame, ts: str, file_key: str) -> DataFrame:
    """AG-15"""
    return df.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count_distinct(file_key).alias("n_files"), F.count(F.lit(1)).alias("n_events"))


def correlation_statistics(df: DataFrame, score: str, record: str, event: str, high: float = 0.8) -> DataFrame:
    """AG-16"""
    return df.agg(F.avg(score).alias("avg_score"), F.count_if(F.col(score) >= high).alias("n_high"), F.count_distinct(record).alias("n_records"), F.count_distinct(event).alias("n_events"))


def having_many(df: DataFrame, key: str, value: str, more_than: int = 1) -> DataFrame:
    """AG-17: keys with more than so many distinct values."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).filter(F.col("n_values") > more_than)


def monthly(df: DataFrame, ts: str) -> DataFrame:
    """AG-17"""
    return df.filter(F.col(ts).isNotNull()).groupBy(F.date_format(F.col(ts).cast("timestamp"), "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def ordered_text(df: DataFrame, key: list[str], text: Column, order: list[str], sep: str = "; ") -> DataFrame:
    """AG-18: texts of a key joined in order: one text, and so one task's array, for each key."""
    return df.withColumn("__t", text).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, "__t"))).alias("__l")).withColumn("changes", F.array_join(F.transform("__l", lambda r: r["__t"]), sep)).drop("__l")


def identity_groups(df: DataFrame, identity: list[str], source: str, ts: str, suffix: str | None = None) -> DataFrame:
    """AG-20: rows, sources, first and last seen of each identity; with its sub-identities by suffix where asked for."""
    per = df.groupBy(*identity, source).agg(F.count(F.lit(1)).alias("__n"), F.min(ts).alias("__first"), F.max(ts).alias("__last"))
    # one row a source of an identity from here on: the distinct sources are a plain list
    out = per.groupBy(*identity).agg(F.sum("__n").alias("n_records"), F.count(source).alias("n_sources"), F.min("__first").alias("first_seen"), F.max("__last").alias("last_seen"), F.array_sort(F.collect_list(source)).alias("sources"))
    if suffix is None:
        return out
    subs = df.groupBy(*identity, suffix).agg(F.count(F.lit(1)).alias("n")).groupBy(*identity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col(suffix), F.lit("")).alias("k"), "n")))).alias("sub_identities"))
    return out.join(subs, identity, "left")


def extraction_statistics(df: DataFrame, source: str, identity: str, problem: str) -> DataFrame:
    """AG-21"""
    got = F.col(identity).isNotNull() & F.col(problem).isNull()
    n = df.groupBy(source).agg(F.count(F.lit(1)).alias("total"), F.count_if(got).alias("extracted"), F.count_if(F.col(identity).isNull()).alias("failed"), F.count_if(F.col(identity).isNotNull() & F.col(problem).isNotNull()).alias("filtered"), F.count_distinct(F.when(got, F.col(identity))).alias("n_identities"))
    top = top_per(df.filter(got), [source], identity, 3).groupBy(source).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", identity))), lambda r: r[identity]).alias("top3"))
    return n.join(top, source, "left")


def identity_registry(refs: DataFrame, value: str, kind: str, ref: list[str]) -> DataFrame:
    """AG-22, AG-23: one row for each (value, type): how many distinct record references, from how many matches."""
    d = refs.filter(F.col(value).isNotNull()).select(value, kind, *ref).distinct()
    return d.groupBy(value, kind).agg(F.count(F.lit(1)).alias("n_refs"), F.count_distinct(ref[0]).alias("n_matches"))


def registry_statistics(registry: DataFrame, kind: str) -> DataFrame:
    return registry.groupBy(kind).agg(F.count(F.lit(1)).alias("n_identities"), F.sum("n_refs").alias("n_refs"), F.round(F.avg("n_refs"), 2).alias("avg_refs"))


def stamp_identity(payload: Column, value: Column, kind: Column) -> Column:
    """AG-24: identity value and type put into each record map of a match's payload."""
    return F.transform_values(payload, lambda s, records: F.transform(records, lambda r: F.map_concat(F.map_filter(r, lambda k, v: ~k.isin("identity_value", "identity_type")), F.create_map(F.lit("identity_value"), value, F.lit("identity_type"), kind))))


def cross_source(df: DataFrame, identity: str, source: str, least: int = 2) -> DataFrame:
    """AG-25"""
    return df.groupBy(identity).agg(F.count_distinct(source).alias("n_sources")).filter(F.col("n_sources") >= least)


def window_summary(df: DataFrame, window: str, source: str, identity: str) -> DataFrame:
    """AG-26: rows, sources and identities of each window, and of each source in it (source null: the whole window)."""
    return df.groupBy(F.col(window), F.col(source)).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(identity).alias("n_identities"), F.lit(1).cast("long").alias("n_sources")).unionByName(
        df.groupBy(window).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(identity).alias("n_identities"), F.count_distinct(source).alias("n_sources")).withColumn(source, F.lit(None).cast(df.schema[source].dataType))
    )


def period_metrics(df: DataFrame, period: str, ts: str, kind: str, identity: str) -> DataFrame:
    """AG-27: totals, identities, density a minute, peak hour and dominant kind of each period."""
    base = df.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(identity).alias("n_identities"), ((us(F.max(F.col(ts).cast("timestamp"))) - us(F.min(F.col(ts).cast("timestamp")))) / F.lit(60.0 * US)).alias("minutes"))
    base = base.withColumn("density", F.when(F.col("minutes") > 0, F.col("n") / F.col("minutes")).otherwise(0.0))
    kinds = top_per(df, [period], kind, 1).select(period, F.col(kind).alias("dominant"))
    peak = top_per(df.withColumn("peak_hour", F.date_trunc("hour", F.col(ts).cast("timestamp"))), [period], "peak_hour", 1).select(period, "peak_hour")
    return base.join(kinds, period, "left").join(peak, period, "left")


def trend(before: Column, after: Column) -> Column:
    """AG-28: percent change in bands: beyond 20 strong, beyond 10 slight."""
    pct = F.when(before > 0, (after - before) * F.lit(100.0) / before)
    return F.when(pct.isNull(), "new").when(pct > 20, "strong increase").when(pct > 10, "increase").when(pct < -20, "strong decrease").when(pct < -10, "decrease").otherwise("stable")


def counted(df: DataFrame, key: list[str], column: str, name: str) -> DataFrame:
    """Rows of each value of a column, as one map for each key."""
    per = df.filter(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(column).alias("k"), "n")))).alias(name))


def period_report(df: DataFrame, period: str, anchor_ts: str, identity: str, kinds: dict[str, str], top: str, dominant: str) -> DataFrame:
    """AG-27: for each period rows, identities, rows a minute between its first and last anchor time (over one minute at
    least), the anchor time with most rows, a map of counts for each of `kinds` (result name -> column), the three most
    frequent values of `top` and the most frequent of `dominant`. Ties go to the earlier time and the lesser value."""
    at = F.col(anchor_ts).cast("timestamp")
    out = df.groupBy(period).agg(F.count(F.lit(1)).alias("total_evidence"), F.count_distinct(identity).alias("unique_identities"), (us(F.max(at)) - us(F.min(at))).alias("__span"))
    out = out.withColumn("activity_density", F.col("total_evidence") / F.greatest(F.col("__span") / F.lit(60.0 * US), F.lit(1.0))).drop("__span")
    parts = [counted(df, [period], c, name) for name, c in kinds.items()]
    parts.append(top_per(df, [period], anchor_ts, 1).select(period, F.col(anchor_ts).alias("peak_ts")))
    listed = lambda c, k: top_per(df.filter(F.col(c).isNotNull()), [period], c, k).groupBy(period).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda r: r[c]).alias("__l"))
    parts.append(listed(top, 3).withColumnRenamed("__l", "top3"))
    parts.append(listed(dominant, 1).select(period, F.get("__l", F.lit(0)).alias("dominant")))
    return reduce(lambda a, b: a.join(b, period, "left"), parts, out)


def change(now: Column, before: Column) -> Column:
    """AG-28: percent change; from nothing it is 100, or 0 if nothing came."""
    return F.when(before > 0, (now - before) * F.lit(100.0) / before).otherwise(F.when(now > 0, 100.0).otherwise(0.0))


def band(percent: Column, width: float) -> Column:
    return F.when(percent > width, F.concat(F.lit("Increased by "), F.format_string("%.1f", percent), F.lit("%"))).when(percent < -width, F.concat(F.lit("Decreased by "), F.format_string("%.1f", F.abs(percent)), F.lit("%"))).otherwise("Stable")


def one_row(parts: list[DataFrame]) -> DataFrame:
    """One-row tables side by side, by a union and one aggregate instead of a join without a key."""
    u = union_all(parts)
    return u.agg(*[F.max(c).alias(c) for c in u.columns])


def trend_report(df: DataFrame, period: str, now: str, before: str, anchor_ts: str, identity: str, kind: str) -> DataFrame:
    """AG-28: one row comparing two periods: bands of +-20 % for rows and +-10 % for identities, the pattern by the ratio of
    densities (1.5 and 0.5), and the advice rules that hold (codes; `normal` if none does)."""
    at, names = F.col(anchor_ts).cast("timestamp"), {"now": now, "was": before}
    of = lambda p, c: F.when(F.col(period) == names[p], c)
    sums = df.agg(*[x for p in names for x in (F.count_if(F.col(period) == names[p]).alias(f"{p}_rows"), (us(F.max(of(p, at))) - us(F.min(of(p, at)))).alias(f"{p}_span"))])
    seen = lambda c: df.filter(F.col(c).isNotNull()).groupBy(c).agg(*[F.max(F.col(period) == names[p]).alias(p) for p in names])
    ids = seen(identity).agg(*[F.count_if(p).alias(f"{p}_ids") for p in names], F.count_if(F.col("now") & F.col("was")).alias("both_ids"), F.count_if(F.col("now") | F.col("was")).alias("any_ids"))
    kinds = seen(kind).agg(F.count_if(F.col("now") & F.col("was")).alias("both_kinds"))
    j = one_row([sums, ids, kinds])
    for p in names:
        j = j.withColumn(f"{p}_density", F.col(f"{p}_rows") / F.greatest(F.coalesce(f"{p}_span", F.lit(0)) / F.lit(60.0 * US), F.lit(1.0)))
    n, w = F.col("now_density"), F.col("was_density")
    activity, growth = change(F.col("now_rows"), F.col("was_rows")), change(F.col("now_ids"), F.col("was_ids"))
    pattern = F.when(n > w * 1.5, "Intensifying activity").when(n < w * 0.5, "Declining activity").otherwise("Consistent activity")
    overlap = F.when(F.col("any_ids") > 0, F.col("both_ids") * F.lit(100.0) / F.col("any_ids")).otherwise(0.0)
    advice = F.array(
        F.when(F.col("now_rows") > F.col("was_rows") * 2, "activity_spike").when(F.col("now_rows") < F.col("was_rows") * 0.5, "activity_drop"),
        F.when(overlap < 20, "low_overlap").when(overlap > 80, "high_overlap"),
        F.when(F.col("both_kinds") < 3, "few_common_kinds"),
        F.when(n > w * 3, "density_spike"),
    )
    said = F.filter(advice, lambda a: a.isNotNull())
    return j.select(
        activity.alias("activity_percent"), band(activity, 20).alias("activity_change"), growth.alias("growth_percent"), band(growth, 10).alias("identity_growth"), pattern.alias("pattern"),
        (n / F.greatest(w, F.lit(0.1))).alias("density_ratio"), overlap.alias("overlap_percent"), F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("normal"))).alias("advice"),
    )


def file_report(files: DataFrame, changes: DataFrame, names: DataFrame) -> DataFrame:
    """AG-17: section, rank, item, n - the parts of a file report, one below the other.

    files(record, name, path, deleted), changes(record, ts), names(record, name, namespace): totals, deleted rows, rows
    under an unknown parent, the 10 names and paths with most rows, the 5 records with most renames, records of several
    names and the 10 with most, namespaces among those, renames in all and by month (the last 12).
    """
    one = lambda section, df, n: df.agg(n.cast("long").alias("n")).select(F.lit(section).alias("section"), F.lit(1).alias("rank"), F.lit(None).cast("string").alias("item"), "n")

    def most(section: str, df: DataFrame, item: Column, k: int | None, order: list[Column] | None = None) -> DataFrame:
        per = df.groupBy(item.cast("string").alias("item")).agg(F.count(F.lit(1)).alias("n")).orderBy(*(order or [F.col("n").desc(), F.col("item")]))
        per = per.limit(k) if k else per  # a report of k
        rank = F.row_number().over(Window.orderBy(*(order or [F.col("n").desc(), F.col("item")])))
        return per.select(F.lit(section).alias("section"), (rank if k else F.lit(1)).alias("rank"), "item", "n")

    filled = names.filter("name is not null and name <> ''")
    several = filled.groupBy("record").agg(F.count_distinct("name").alias("n_names")).filter("n_names > 1")
    dated = changes.filter(F.col("ts").isNotNull())
    by_names = several.orderBy(F.col("n_names").desc(), "record").limit(10)
    by_names = by_names.select(F.lit("most_names").alias("section"), F.row_number().over(Window.orderBy(F.col("n_names").desc(), "record")).alias("rank"), F.col("record").cast("string").alias("item"), F.col("n_names").alias("n"))
    return union_all([
        one("rows", files, F.count(F.lit(1))), one("records", files, F.count_distinct("record")), one("deleted", files, F.count_if(F.col("deleted"))),
        one("unknown_parent", files, F.count_if(F.coalesce(F.col("path").contains("[Unknown Parent"), F.lit(False)))), one("renames", changes, F.count(F.lit(1))), one("several_names", several, F.count(F.lit(1))),
        most("most_modified", files.filter("name is not null"), F.concat_ws("|", "name", F.coalesce("path", F.lit(""))), 10), most("most_renamed", changes, F.col("record"), 5), by_names,
        most("namespace", names.join(several.select("record"), "record", "left_semi"), F.col("namespace"), None), most("month", dated, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM"), 12, [F.col("item").desc()]),
    ])


def exact_time_groups(df: DataFrame, ts: str) -> DataFrame:
    """AG-29"""
    return df.groupBy(ts).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def groups_of(df: DataFrame, key: Column, name: str = "group_key") -> DataFrame:
    """AG-30: groups by an extracted key with more than one row."""
    return df.withColumn(name, key).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mode_share(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """AG-31: share of the most common value; 1 under two values."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*key).agg((F.max("n") / F.sum("n")).alias("similarity"))


def usage(df: DataFrame, app: str, ts: str, sums: dict[str, Column], k: int | None = None) -> DataFrame:
    """AG-32: totals with first and last activity, largest first; a report of k where asked for."""
    first = next(iter(sums))
    out = df.groupBy(app).agg(*[F.sum(c).alias(n) for n, c in sums.items()], F.min(ts).alias("first_active"), F.max(ts).alias("last_active")).orderBy(F.col(first).desc(), app)
    return out.limit(k) if k else out


def count_kinds(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """AG-33, AG-35: one row of conditional counts."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def pivot_latest(df: DataFrame, key: list[str], name: str, value: str, order: list[str], names: list[str]) -> DataFrame:
    """AG-34: the latest value of each name as columns."""
    return df.groupBy(*key).pivot(name, names).agg(F.max_by(value, F.struct(*order)))


def summary(df: DataFrame, score: str, sources: str, app: str) -> DataFrame:
    """AG-35, AG-41"""
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(score), 3).alias("avg_score"), F.round(F.avg(sources), 3).alias("avg_sources"), F.array_sort(F.collect_set(app)).alias("apps"))


def export_summary(matches: DataFrame, tabs: DataFrame, score: str, semantic: str, scoring: str) -> DataFrame:
    """AG-35: matches, average score (3 digits, 0 without matches), tabs, and the percent of tabs with semantic mappings and
    with a scoring configuration (1 digit, 0 without tabs)."""
    percent = lambda c: F.coalesce(F.round(F.count_if(F.col(c)) * F.lit(100.0) / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(0.0))
    m = matches.agg(F.count(F.lit(1)).alias("total_matches"), F.coalesce(F.round(F.avg(score), 3), F.lit(0.0)).alias("average_score"))
    t = tabs.agg(F.count(F.lit(1)).alias("total_tabs"), F.count_if(F.col(semantic)).alias("tabs_with_semantics"), F.count_if(F.col(scoring)).alias("tabs_with_scoring"), percent(semantic).alias("semantic_percent"), percent(scoring).alias("scoring_percent"))
    return one_row([m, t])


def audit_summary(lines: DataFrame, pattern: str = r"^(\S+ \S+) \[(\w+)\]", column: str = "value") -> DataFrame:
    """AG-36: log lines by action, with first and last time."""
    got = lines.select(F.regexp_extract(column, pattern, 1).alias("t"), F.regexp_extract(column, pattern, 2).alias("action")).filter("action <> ''")
    return got.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def both_ends(df: DataFrame, order: list[str], k: int = 10) -> DataFrame:
    """AG-38: the first and the last k rows (the feature itself)."""
    head = df.orderBy(*order).limit(k).withColumn("part", F.lit("head"))
    tail = df.orderBy(*[F.col(c).desc() for c in order]).limit(k).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def dense_days(heat_rows: DataFrame, day: str = "day", source: str = "source", n: str = "n", years: int = 5) -> DataFrame:
    """AG-39: every UTC day from first to last (the last 5 years at most) with each source's count, 0 included."""
    every = Window.partitionBy()  # over one row a source
    span = heat_rows.groupBy(source).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    span = span.withColumn("__hi", F.max("__hi").over(every)).withColumn("__lo", F.greatest(F.min("__lo").over(every), F.add_months(F.col("__hi"), -12 * years)))
    grid = span.select(source, F.explode(F.sequence("__lo", "__hi")).alias(day))
    per = heat_rows.groupBy(day, source).agg(F.sum(n).alias(n))
    return grid.join(per, [day, source], "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))


def set_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """ST-03: sizes of intersection, both differences and union of two columns' values, and the percent in common."""
    x, y = a.select(column).distinct().withColumn("a", F.lit(1)), b.select(column).distinct().withColumn("b", F.lit(1))
    j = x.join(y, column, "full")
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return j.agg(both.alias("n_both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count(F.lit(1)).alias("n_union"), F.round(both * F.lit(100.0) / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("percent"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """ST-01: columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    """ST-02"""
    return union_all(parts).distinct()


def anchor_group_totals(groups: DataFrame, evidence: DataFrame, group: str, start: str, end: str, identity: str, kind: str, key: str) -> DataFrame:
    """AG-40: identities, evidence rows and the three most frequent kinds of each group of anchors."""
    j = groups.join(evidence, key)
    base = groups.groupBy(group).agg(F.count_distinct(identity).alias("n_identities"), F.min(start).alias("first_ts"), F.max(end).alias("last_ts"))
    n = j.groupBy(group).agg(F.count(F.lit(1)).alias("n_evidence"))
    top = top_per(j, [group], kind, 3).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", kind))), lambda r: r[kind]).alias("top3"))
    return base.join(n, group, "left").join(top, group, "left")
