"""Ordered analytics (WN-01..WN-19): gaps and islands, fixed-origin folds, sessions, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.operators.joins import US, us
from evspark.storage import written


DAY_S = 86_400
#: Rows of a slice, if all were of one key: what one task's window may hold.
SLICE_ROWS = 1_000_000


def slices(df: DataFrame, at: Column, rows: int = SLICE_ROWS) -> Column | None:
    """The slice of each row along its order, a whole number `at`: as wide as holds `rows` rows of the table on average, so
    that a key with most of the rows is cut too. None where the whole table has no more rows than that: there is nothing
    to cut. Rows without a place come first, as in any order."""
    n, lo, hi = df.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
    if n <= rows or lo is None:
        return None
    return F.coalesce(F.floor(at / max(1, (hi - lo + 1) * rows // n)), F.lit(-(1 << 62)))


def _with_key(df: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    """The key as one column (null keys are a key), or none for one order over all rows."""
    return (df.withColumn("__k", F.struct(*key)), ["__k"]) if key else (df, [])


def beside(df: DataFrame, key: list[str], order: list[Column], near: dict[str, Column], slice_: Column | None, step: int = -1) -> DataFrame:
    """df with the values of the row before (step -1) or after (1) in its key's order, null where there is none: lag and
    lead without a key's rows in one task.

    Rows are cut into slices of their key's order (`slice_` never falls along it). Inside a slice a window does; across
    slices each hands on one row, its last (first), to the next slice that has rows, where it stands before (after) the
    others. So the only order over a whole key is one over its slices.
    """
    if slice_ is None:
        w = Window.partitionBy(*key).orderBy(*order)
        return df.select("*", *[(F.lag if step < 0 else F.lead)(v).over(w).alias(name) for name, v in near.items()])
    rows, k = _with_key(df.withColumn("__slice", slice_), key)
    values, rank = F.struct(*[v.alias(name) for name, v in near.items()]), F.struct(*order)
    edge = (F.max_by if step < 0 else F.min_by)(F.struct(values.alias("values"), rank.alias("rank")), rank)
    slices = rows.groupBy(*k, "__slice").agg(edge.alias("__edge"))
    w = Window.partitionBy(*k).orderBy("__slice")
    taken = (F.lag if step < 0 else F.lead)("__edge").over(w)
    slices = slices.select(*k, "__slice", taken.alias("__edge")).filter("__edge is not null")
    whole = rows.withColumn("__values", values).withColumn("__rank", rank).withColumn("__own", F.lit(True))
    handed = slices.select(*k, "__slice", F.col("__edge.values").alias("__values"), F.col("__edge.rank").alias("__rank"), F.lit(False).alias("__own"))
    inner = Window.partitionBy(*k, "__slice").orderBy(*[F.col("__rank")[f] for f in whole.schema["__rank"].dataType.names], "__own" if step < 0 else F.col("__own").desc())
    found = whole.unionByName(handed, allowMissingColumns=True).withColumn("__near", (F.lag if step < 0 else F.lead)("__values").over(inner)).filter("__own")
    for name in near:
        found = found.withColumn(name, F.col("__near")[name])
    return found.drop("__slice", "__values", "__rank", "__own", "__near", *k)


def counted_before(df: DataFrame, key: list[str], order: list[Column], hit: Column, slice_: Column | None, name: str, own: bool) -> DataFrame:
    """df with how many rows of its key up to each row (the row itself included if `own`) are hits: counts inside a slice
    by a window, and those of the slices before from one row a slice."""
    if slice_ is None:
        w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        return df.withColumn(name, F.coalesce(F.count_if(hit).over(w), F.lit(0)))
    rows, k = _with_key(df.withColumn("__slice", slice_).withColumn("__hit", F.coalesce(hit.cast("long"), F.lit(0))), key)
    slices = rows.groupBy(*k, "__slice").agg(F.sum("__hit").alias("__hits"))
    earlier = F.sum("__hits").over(Window.partitionBy(*k).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(*k, "__slice", F.coalesce(earlier, F.lit(0)).alias("__offset"))
    w = Window.partitionBy(*k, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    inner = rows.withColumn("__inner", F.coalesce(F.sum("__hit").over(w), F.lit(0)))
    return inner.join(slices, [*k, "__slice"]).withColumn(name, F.col("__inner") + F.col("__offset")).drop("__slice", "__hit", "__inner", "__offset", *k)


def name_changes(df: DataFrame, key: list[str], order: list[str], columns: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """WN-01: rows where one of the columns differs from the row before, with the old values as prev_*; distinct. The first
    of `order` is a time."""
    df = beside(df, key, [F.col(c) for c in order], {f"prev_{c}": F.col(c) for c in columns}, slices(df, us(order[0]), slice_rows))
    changed = [F.col(f"prev_{c}").isNotNull() & (F.col(f"prev_{c}") != F.col(c)) for c in columns]
    hit = changed[0]
    for c in changed[1:]:
        hit = hit | c
    return df.filter(hit).dropDuplicates([*key, *columns, *[f"prev_{c}" for c in columns]])


def islands(df: DataFrame, key: list[str], ts: str, seconds: int, tie: list[str] | None = None, name: str = "island", slice_rows: int = SLICE_ROWS, slice_seconds: int | None = None) -> DataFrame:
    """WN-02, WN-03: a row starts a new island when its gap from the row before is over `seconds`. Rows without a time
    are of the first island. An empty key gives one order over all rows.

    Rows are cut into slices of time (`slices`, or as wide as asked for). Inside a slice the gaps are found and counted by
    windows; across slices only each slice's first and last instant and its number of breaks matter: one row a slice, over
    which the offsets are summed.
    """
    width, order = seconds * US, [us(ts), *(tie or [])]
    slice_ = F.floor(us(ts) / (slice_seconds * US)) if slice_seconds else slices(df, us(ts), slice_rows)
    if slice_ is None and not key:
        slice_ = F.floor(us(ts) / (DAY_S * US))
    new = lambda rows, by, w: rows.withColumn("__new", F.when(us(ts) - F.lag(us(ts)).over(w.orderBy(*by)) > width, 1).otherwise(0))
    if slice_ is None:
        w = Window.partitionBy(*key)
        return new(df, order, w).withColumn(name, F.sum("__new").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("__new")
    timed, k = _with_key(df.filter(F.col(ts).isNotNull()).withColumn("__slice", slice_), key)
    cut = [*k, "__slice"]
    w = Window.partitionBy(*cut)
    inner = new(timed, order, w).withColumn("__no", F.sum("__new").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    edge = new(timed.select(*cut, ts), [us(ts)], w).groupBy(*cut).agg(F.min(us(ts)).alias("__lo"), F.max(us(ts)).alias("__hi"), F.sum("__new").alias("__breaks"))
    over = Window.partitionBy(*k).orderBy("__slice")
    starts = F.when(F.col("__lo") - F.lag("__hi").over(over) > width, 1).otherwise(0) + F.coalesce(F.lag("__breaks").over(over), F.lit(0))
    edge = edge.withColumn("__starts", starts).select(*cut, F.sum("__starts").over(over).alias("__offset"))
    found = inner.join(edge, cut).withColumn(name, F.col("__no") + F.col("__offset")).drop("__slice", "__new", "__no", "__offset", *k)
    return found.unionByName(df.filter(F.col(ts).isNull()).withColumn(name, F.lit(0).cast("long")))


def global_islands(df: DataFrame, ts: str, seconds: int, tie: list[str] | None = None, slice_seconds: int | None = None, name: str = "island") -> DataFrame:
    """WN-02 over one global order."""
    return islands(df, [], ts, seconds, tie, name, slice_seconds=slice_seconds)


def gap_clusters(df: DataFrame, key: list[str], ts: str, seconds: int, least: int = 1, extra: list[Column] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """WN-02..WN-04: start, end, duration, number of rows of each island; small ones can be left out.

    Rows without a time form one island more for each key, with null times.
    """
    rows = islands(df, key, ts, seconds, slice_rows=slice_rows).withColumn("island", F.when(F.col(ts).isNotNull(), F.col("island")).otherwise(-1).cast("long"))
    out = rows.groupBy(*key, "island").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n"), *(extra or []))
    out = out.filter(F.col("n") >= least) if least > 1 else out
    return out.withColumn("duration_s", (us("end_ts") - us("start_ts")) / F.lit(float(US)))


def session_anchors(df: DataFrame, key: list[str], ts: str, seconds: int, extra: list[Column] | None = None) -> DataFrame:
    """WN-04 by session_window, whose gap is exclusive: a microsecond is added so that a gap of exactly W stays inside."""
    w = F.session_window(F.col(ts).cast("timestamp"), f"{seconds} seconds 1 microseconds").alias("w")
    return df.groupBy(*key, w).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n"), *(extra or [])).drop("w")


#: Steps from the roots before jumps are doubled.
STEPS = 6


def cluster_starts(instants: DataFrame, key: list[str], width: int) -> DataFrame:
    """key, __b, __t: where clusters start among distinct instants (key, __b, __t); __b is the instant's bucket of `width`
    microseconds.

    After a gap of over `width` a cluster always starts. From such a root the next start is the first instant over `width`
    later, and so on: each instant's successor is found in the next two buckets, and the starts are what roots reach. A
    chain ends before the next root. Most chains are short, and a few steps from the roots follow them; what is left then
    is found by doubling the jumps. No window or join meets more than a bucket of one key.
    """
    bucket = [*key, "__b"]
    lows = instants.groupBy(*bucket).agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"))
    order = Window.partitionBy(*bucket).orderBy("__t")
    before = lows.select(*key, (F.col("__b") + 1).alias("__b"), F.col("__hi").alias("__last"))
    gap = F.col("__t") - F.coalesce(F.lag("__t").over(order), F.col("__last"))
    roots = instants.join(before, bucket, "left").withColumn("__gap", gap).filter(F.col("__gap").isNull() | (F.col("__gap") > width))
    # each instant asks its next bucket for the first one over `width` later; else the bucket after that has it
    asks = instants.select(*key, (F.col("__b") + 1).alias("__b"), (F.col("__t") + width).alias("__at"), F.col("__t").alias("__from"), F.lit(None).cast("long").alias("__t"))
    both = instants.select(*bucket, F.col("__t").alias("__at"), F.lit(None).cast("long").alias("__from"), "__t").unionByName(asks)
    # latest first: a frame that starts with its partition is a running value, one that ends with it is taken anew each row
    later = Window.partitionBy(*bucket).orderBy(F.col("__at").desc()).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__next", F.min("__t").over(later)).filter("__from is not null")
    after = lows.select(*key, (F.col("__b") - 1).alias("__b"), F.col("__lo").alias("__first"))
    jumps = found.join(after, bucket, "left").select(*key, F.col("__from").alias("__t"), F.coalesce("__next", "__first").alias("__to")).filter(F.col("__to") - F.col("__t") <= 2 * width)
    at = [*key, "__t"]
    roots = written(roots.select(*at))
    jumps = written(jumps.join(roots.withColumnRenamed("__t", "__to"), [*key, "__to"], "left_anti").select(*at, "__to"))
    found, front = [roots], roots
    for _ in range(STEPS):
        front = written(front.join(jumps, at).select(*key, F.col("__to").alias("__t")))
        if front.isEmpty():
            return reduce(DataFrame.unionByName, found).withColumn("__b", F.floor(F.col("__t") / width))
        found.append(front)
    starts = reduce(DataFrame.unionByName, found)
    while not jumps.isEmpty():
        starts = written(starts.unionByName(starts.join(jumps, [*key, "__t"]).select(*key, F.col("__to").alias("__t"))))
        second = jumps.select(*key, F.col("__t").alias("__to"), F.col("__to").alias("__further"))
        jumps = written(jumps.join(second, [*key, "__to"]).select(*key, "__t", F.col("__further").alias("__to")))
    return starts.distinct().withColumn("__b", F.floor(F.col("__t") / width))


def fixed_origin(df: DataFrame, key: list[str], ts: str, id_col: str, seconds: int) -> DataFrame:
    """WN-05..WN-07: each row's cluster, where a row starts a new one when it is over `seconds` after the CLUSTER's start.

    Starts are found among distinct instants (cluster_starts). A row's start lies in its own bucket or the one before, so
    a bucket of one key is all that meets in a task. Without a key there is one order over all rows.
    """
    width = seconds * US
    rows, k = _with_key(df.filter(F.col(ts).isNotNull()).withColumn("__t", us(ts)).withColumn("__b", F.floor(us(ts) / width)), key)
    bucket = [*k, "__b"]
    starts = written(cluster_starts(written(rows.select(*bucket, "__t").distinct()), k, width))
    last = Window.partitionBy(*bucket).orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts.select(*bucket, "__t", F.col("__t").alias("__start")), [*bucket, "__t"], "left").withColumn("__start", F.max("__start").over(last))
    before = starts.groupBy(*k, (F.col("__b") + 1).alias("__b")).agg(F.max("__t").alias("__before"))
    placed = placed.join(before, bucket, "left")
    return placed.select(*key, F.timestamp_micros(F.coalesce("__start", "__before")).alias("cluster_start"), id_col, F.timestamp_micros("__t").alias(ts))


def fixed_origin_clusters(df: DataFrame, key: list[str], ts: str, id_col: str, seconds: int, least: int = 2) -> DataFrame:
    """WN-06, WN-07: start, end, upper median, size, is_cluster (size of `least` or more). Rows are summed by instant first."""
    at = fixed_origin(df, key, ts, id_col, seconds).groupBy(*key, "cluster_start", ts).agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*key, "cluster_start")
    at = at.withColumn("__n", F.sum("__c").over(group)).withColumn("__upto", F.sum("__c").over(group.orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)))
    median = F.min(F.when(F.col("__upto") > F.floor(F.col("__n") / 2), F.col(ts)))
    return at.groupBy(*key, "cluster_start").agg(F.max(ts).alias("cluster_end"), F.sum("__c").alias("n"), median.alias("median_ts")).withColumn("is_cluster", F.col("n") >= least)


def first_fit(df: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """WN-08: in time order, first fit is the gap rule."""
    return islands(df, key, ts, seconds)


def anchor_time_groups(anchors: DataFrame, key: list[str], start: str, id_col: str, seconds: int) -> DataFrame:
    """WN-09: groups of anchor starts: a start over `seconds` after the GROUP's start opens the next. An empty key gives
    one order over all anchors."""
    got = fixed_origin(anchors.select(*key, start).distinct(), key, start, start, seconds)
    return anchors.join(got.toDF(*key, "group_start", "__at", start).drop("__at"), [*key, start])


def primary_evidence(df: DataFrame, anchor: list[str], priority: Column, ts: str, id_col: str) -> DataFrame:
    """WN-10: role primary for the best artifact, then the LATEST time; others secondary; no time: supporting."""
    w = Window.partitionBy(*anchor).orderBy(F.col(ts).isNull(), priority.desc(), F.col(ts).desc(), id_col)
    return df.withColumn("role", F.when(F.col(ts).isNull(), "supporting").when(F.row_number().over(w) == 1, "primary").otherwise("secondary"))


def anchor_source(df: DataFrame, source: str, priority: list[str], override: str | None = None) -> DataFrame:
    """WN-11: one row: the source whose rows become anchors: the override, else the first of the list that has rows."""
    rank = F.array_position(F.array(*[F.lit(p) for p in [*([override] if override else []), *priority]]), F.col(source))
    n = df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.when(rank > 0, rank).otherwise(1_000_000))
    return n.agg(F.min_by(source, F.struct("rank", source)).alias("anchor_source"), F.min_by("n", F.struct("rank", source)).alias("n_anchors"))


# System-log event ids of power and logon changes.
POWER_EVENTS = {12: "power_on", 6005: "power_on", 6009: "power_on", 13: "power_off", 6006: "power_off", 109: "power_off", 41: "unexpected_shutdown", 6008: "unexpected_shutdown", 42: "sleep", 27: "hibernate", 1: "wake", 107: "wake", 28: "wake", 1074: "shutdown"}
LOGON_EVENTS = {4624: "login", 4634: "logout", 4800: "lock", 4801: "unlock"}


def power_events(df: DataFrame, event_id: str = "event_id") -> DataFrame:
    """WN-14: rows of known event ids with their kind."""
    pairs = [F.lit(x) for k, v in (POWER_EVENTS | LOGON_EVENTS).items() for x in (k, v)]
    return df.withColumn("kind", F.element_at(F.create_map(*pairs), F.col(event_id).cast("int"))).filter("kind is not null")


def power_sessions(df: DataFrame, key: list[str], ts: str, is_open: Column, is_close: Column, tie: list[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """WN-12: the first opener starts a session, the next closer ends it; further openers don't count; an open tail
    stays open. Island number = closers before the row."""
    rows = df.filter(is_open | is_close)
    rows = counted_before(rows, key, [us(ts), *(tie or [])], is_close, slices(rows, us(ts), slice_rows), "island", own=False)
    out = rows.groupBy(*key, "island").agg(F.min(F.when(is_open, F.col(ts))).alias("start_ts"), F.min(F.when(is_close, F.col(ts))).alias("end_ts"))
    return out.filter("start_ts is not null").drop("island").withColumn("duration_s", (us("end_ts") - us("start_ts")) / F.lit(float(US)))


def uptime(sessions: DataFrame, key: list[str]) -> DataFrame:
    """WN-13: totals; the average is over completed sessions."""
    return sessions.groupBy(*key).agg(F.count(F.lit(1)).alias("n_sessions"), F.count("end_ts").alias("n_completed"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("uptime_s"), F.avg("duration_s").alias("avg_s"))


def session_bands(df: DataFrame, key: list[str], ts: str, opens: Column, closes: Column, shutdowns: Column, tie: list[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """WN-15: every opener makes a band up to the next own event or shutdown: `closed`, `superseded` by another
    opener, `shutdown`, or `ongoing`; a band is dirty if it wasn't closed by its own closer."""
    kind = F.when(opens, "open").when(closes, "close").when(shutdowns, "shutdown")
    rows = df.withColumn("__kind", kind).filter("__kind is not null")
    rows = beside(rows, key, [us(ts), *map(F.col, tie or [])], {"end_ts": F.col(ts), "__next": F.col("__kind")}, slices(rows, us(ts), slice_rows), 1).filter("__kind = 'open'")
    end = F.when(F.col("__next") == "close", "closed").when(F.col("__next") == "open", "superseded").when(F.col("__next") == "shutdown", "shutdown").otherwise("ongoing")
    return rows.select(*key, F.col(ts).alias("start_ts"), "end_ts", end.alias("end_kind"), (end != "closed").alias("dirty"))


def clip(df: DataFrame, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """Bands that overlap a range, cut to it; open ends count as lasting."""
    df = df.filter((F.col(start) <= hi) & (F.col(end).isNull() | (F.col(end) >= lo)))
    return df.withColumn(start, F.greatest(F.col(start), lo)).withColumn(end, F.least(F.coalesce(F.col(end), hi), hi))


def time_sample(df: DataFrame, ts: str, id_col: str, lo_us: int, hi_us: int, slices: int, most: int) -> DataFrame:
    """WN-16: equal time slices, at most so many rows of each (the feature itself), one row an id."""
    width = max(1, -(-(hi_us - lo_us + 1) // slices))
    rows = df.dropDuplicates([id_col]).filter(us(ts).between(F.lit(lo_us), F.lit(hi_us))).withColumn("slice", F.floor((us(ts) - lo_us) / width).cast("int"))
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy("slice").orderBy(us(ts), id_col))).filter(F.col("__rn") <= most).drop("__rn")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """WN-17"""
    return df.orderBy(*order).limit(k)


def sequence_gaps(df: DataFrame, volume: list[str], usn: str, length: Column, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """WN-18: where the next record doesn't start where this one ends."""
    rows = beside(df.withColumn("__end", F.col(usn) + length), volume, [F.col(usn)], {"gap_end": F.col(usn)}, slices(df, F.col(usn).cast("long"), slice_rows), 1)
    gap = F.col("gap_end") - F.col("__end")
    return rows.select(*volume, F.col("__end").alias("gap_start"), "gap_end", gap.alias("gap_size")).filter("gap_size > 0")


def activity_intervals(df: DataFrame, app: list[str], ts: str, duration_s: Column, least_s: float = 20.0, tie: list[str] | None = None, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """WN-19: intervals that end at ts and last the duration (at least 20 s), starting no earlier than the same app's
    previous end."""
    start = us(ts) - F.round(F.greatest(duration_s, F.lit(least_s)) * US).cast("long")
    rows = beside(df.withColumn("__start", start), app, [us(ts), *map(F.col, tie or [])], {"__before": us(ts)}, slices(df, us(ts), slice_rows))
    return rows.withColumn("start_ts", F.timestamp_micros(F.greatest("__start", "__before"))).withColumn("end_ts", F.col(ts).cast("timestamp")).drop("__start", "__before")
