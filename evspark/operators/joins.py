"""Joins (JN-01..JN-20): banded time joins by buckets, interval overlap, enrichment, parent chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.storage import written

US = 1_000_000


def us(c: str | Column) -> Column:
    """An instant as microseconds since 1970."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


BROADCAST_ROWS = 100_000


def config_table(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of configuration, counted against a bound and broadcast; a larger one is left to a shuffle."""
    return df if df.limit(most + 1).count() > most else F.broadcast(df)


def cell_join(left: DataFrame, right: DataFrame, on: list[str], side: int = 10_000, order: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """An equi-join in which no key is one task's work (cells). With `order` (columns of the left and of the right side),
    rows of one side meet those of the other in their order, up or down, so that a table of the pairs has long runs and
    packs well; the pairs themselves are never sorted."""
    x, y, keys = cells(left, right, on, side)
    if order:
        # the condition always holds: Spark drops a sort before a join, but not one below a condition on row numbers
        x, y = (df.repartition(*keys).sortWithinPartitions(*keys, *by).filter(F.monotonically_increasing_id() >= 0) for df, by in zip((x, y), order, strict=True))
    return x.join(y, keys).drop(*keys[len(on) :])


def cells(left: DataFrame, right: DataFrame, on: list[str], side: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an equi-join, made ready for one on finer keys. A key's pairs are a matrix of its left and right
    rows; where one of the sides has more than `side` rows, the matrix is cut into cells of about that size. A left row
    takes a line of cells, a right row a column, so that each pair meets in exactly one cell.

    Both sides are counted by key first. A key that is cut has over `side` rows on one side, so such keys are few; they
    are broadcast behind a count (config_table).
    """
    n = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    cut = lambda c: F.ceil(F.col(c) / side).cast("int")
    hot = n(left, "__l").join(n(right, "__r"), on).filter((F.col("__l") > side) | (F.col("__r") > side)).select(*on, cut("__l").alias("__lines"), cut("__r").alias("__columns"))
    hot = written(hot)
    if hot.isEmpty():
        return left, right, on
    hot = config_table(hot)
    at = lambda parts: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(F.col(parts), F.lit(1))).cast("int")
    all_of = lambda parts: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)) - 1))
    x = left.join(hot, on, "left").withColumn("__line", at("__lines")).withColumn("__column", all_of("__columns")).drop("__lines", "__columns")
    y = right.join(hot, on, "left").withColumn("__column", at("__columns")).withColumn("__line", all_of("__lines")).drop("__lines", "__columns")
    return x, y, [*on, "__line", "__column"]


def band_join(anchors: DataFrame, rows: DataFrame, seconds: int, anchor_ts: str, row_ts: str, on: list[str] | None = None, side: int = 10_000, order: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """JN-01: every anchor with every row within +-seconds (both ends inclusive), `dt_s` apart.

    Anchors are copied to three neighbouring time buckets of that width, so the join is an equi-join on the bucket
    (and `on`), checked exactly afterwards. No pair is met twice, since a row lies in one bucket. A crowded bucket is
    cut into cells (cell_join). `order`: see cell_join.
    """
    width = seconds * US
    at = F.floor(us(anchor_ts) / width)
    a = anchors.withColumn("__bucket", F.explode(F.array(at - 1, at, at + 1)))
    b = rows.withColumn("__bucket", F.floor(us(row_ts) / width))
    j = cell_join(a, b, ["__bucket", *(on or [])], side, order)
    gap = us(row_ts) - us(anchor_ts)
    return j.filter(F.abs(gap) <= width).withColumn("dt_s", F.abs(gap) / F.lit(float(US))).drop("__bucket")


def band_join_lists(anchors: DataFrame, rows: DataFrame, seconds: int, anchor_ts: str, row_ts: str, side: int = 10_000, task_rows: int = 65_536) -> DataFrame:
    """JN-01: the rows of band_join, by way of lists. Rows of one side at the same time are one list of a bucket (or of a
    cell of it, so that a list is bounded); lists meet, are checked once, and are spelled out as pairs behind the join.

    A pair of lists comes out in one piece, each anchor with the same run of rows, so that a table of the pairs packs
    well. A task gets some `task_rows` rows of a bucket's side at most: its pairs are far more than that, and Parquet
    gives up its dictionary of ids beyond 131,072 (1 MB) of them.
    """
    width = seconds * US
    at = F.floor(us(anchor_ts) / width)
    a = anchors.filter(F.col(anchor_ts).isNotNull()).withColumn("__bucket", F.explode(F.array(at - 1, at, at + 1)))
    b = rows.filter(F.col(row_ts).isNotNull()).withColumn("__bucket", F.floor(us(row_ts) / width))
    tasks = max(-(-rows.count() // task_rows), rows.sparkSession.sparkContext.defaultParallelism)
    x, y, keys = cells(a, b, ["__bucket"], side)

    def lists(df: DataFrame, ts: str, own: list[str], name: str) -> DataFrame:
        df = df.repartition(tasks, *keys).groupBy(*keys, ts).agg(F.collect_list(F.struct(*[c for c in own if c != ts])).alias(name))
        # the condition always holds: as in cell_join
        return df.sortWithinPartitions(*keys, ts).filter(F.monotonically_increasing_id() >= 0)

    # merged, never broadcast: files of equal times are far smaller than their rows
    j = lists(x, anchor_ts, anchors.columns, "__as").hint("merge").join(lists(y, row_ts, rows.columns, "__bs"), keys)
    gap = F.abs(us(row_ts) - us(anchor_ts))
    j = j.filter(gap <= width).select(anchor_ts, row_ts, (gap / F.lit(float(US))).alias("dt_s"), "__bs", F.explode("__as").alias("__a"))
    j = j.select(anchor_ts, row_ts, "dt_s", "__a", F.explode("__bs").alias("__b"))
    out = lambda df, side, ts: [F.col(c) if c == ts else F.col(side)[c].alias(c) for c in df.columns]
    return j.select(*out(anchors, "__a", anchor_ts), *out(rows, "__b", row_ts), "dt_s")


def nearest(pairs: DataFrame, anchor_key: str, row_key: str, per: list[str] | None = None) -> DataFrame:
    """JN-02: the nearest row of each anchor (and each of `per`), ties to the smaller row key."""
    w = Window.partitionBy(anchor_key, *(per or [])).orderBy("dt_s", row_key)
    return pairs.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def match_combinations(pairs: DataFrame, anchor_key: str, source: str, row_key: str, min_other_sources: int = 1, most: int = 100) -> DataFrame:
    """JN-03: anchor, combo_no, source -> row: number 0 takes the best row of every source, the others put one
    further row in the place of one source's best. Anchors with too few other sources drop out.

    Candidates are numbered within their anchor, so a combination is one row here, not a copy of all its members;
    combination_rows() spells them out. `most` is the operator's own limit an anchor, 100 in its definition.
    """
    by = Window.partitionBy(anchor_key, source).orderBy("dt_s", row_key)
    ranked = pairs.withColumn("rank", F.row_number().over(by))
    sources = ranked.filter("rank = 1").groupBy(anchor_key).agg(F.count(F.lit(1)).alias("n_sources")).filter(F.col("n_sources") >= min_other_sources)
    ranked = ranked.join(sources, anchor_key)
    best = ranked.filter("rank = 1").select(anchor_key, "n_sources", F.lit(0).cast("long").alias("combo_no"), F.lit(None).cast(ranked.schema[source].dataType).alias("swapped"), F.lit(None).cast(ranked.schema[row_key].dataType).alias("swap_row")).dropDuplicates([anchor_key])
    swap_no = F.row_number().over(Window.partitionBy(anchor_key).orderBy(source, "rank"))
    swaps = ranked.filter("rank > 1").select(anchor_key, "n_sources", swap_no.cast("long").alias("combo_no"), F.col(source).alias("swapped"), F.col(row_key).alias("swap_row"))
    return best.unionByName(swaps).filter(F.col("combo_no") < most)


def combination_rows(combos: DataFrame, pairs: DataFrame, anchor_key: str, source: str, row_key: str) -> DataFrame:
    """anchor, combo_no, source, row for each member of each combination."""
    best = nearest(pairs, anchor_key, row_key, [source]).select(anchor_key, source, row_key)
    full = combos.select(anchor_key, "combo_no", "swapped", "swap_row").join(best, anchor_key)
    return full.select(anchor_key, "combo_no", source, F.when(F.col("swapped") == F.col(source), F.col("swap_row")).otherwise(F.col(row_key)).alias(row_key))


def correlate_all(events: DataFrame, seconds: int, key: str = "event_id", source: str = "source", ts: str = "ts") -> DataFrame:
    """JN-04: every row of every source is an anchor; its pairs with rows of other sources."""
    a = events.select(F.col(key).alias("anchor_id"), F.col(source).alias("anchor_source"), F.col(ts).alias("anchor_ts"))
    b = events.select(F.col(key).alias("row_id"), F.col(source).alias("row_source"), F.col(ts).alias("row_ts"))
    return band_join(a, b, seconds, "anchor_ts", "row_ts").filter("anchor_source <> row_source")


def cross_source_join(tables: dict[str, DataFrame], key: str, keep: Column | None = None) -> DataFrame:
    """JN-05: an equi-join of all sources on the identity key, columns prefixed by the source."""
    out = None
    for name, df in tables.items():
        side = df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key])
        out = side if out is None else out.join(side, key)
    return out.filter(keep) if keep is not None else out


def with_any(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """JN-06: the rows that have a partner, each once."""
    return rows.join(others.select(key), key, "left_semi")


def overlaps(start: Column, end: Column, lo, hi) -> Column:
    """JN-07 for fixed bounds: closed intervals overlap."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return (start <= lit(hi)) & (end >= lit(lo))


def interval_join(a: DataFrame, b: DataFrame, a_start: str, a_end: str, b_start: str, b_end: str, seconds: int, side: int = 10_000) -> DataFrame:
    """JN-07 between tables: closed intervals that overlap.

    They do if the later start lies within the other interval, so each pair comes from one of two joins of points with
    intervals. Buckets have widths of `seconds` times a power of 8, one level a power; an interval goes to the level
    where it covers two buckets at most, however long it is, and a point to its one bucket of each level that holds
    intervals at all. Wide buckets gather many points: those are cut into cells (cell_join).
    """
    base, levels = seconds * US, 1
    while base * 8 ** (levels - 1) < 1 << 56:
        levels += 1
    widths = [base * 8**k for k in range(levels)]
    level_of = lambda s, e: sum([F.when(us(e) - us(s) > w, 1).otherwise(0) for w in widths[:-1]], F.lit(0))
    slot = lambda k, t: F.floor(t / F.element_at(F.array(*[F.lit(w) for w in widths]), k + 1))

    def within(points: DataFrame, start: str, spans: DataFrame, s: str, e: str, strict: bool) -> DataFrame:
        k, held = F.col("__level"), spans.withColumn("__level", level_of(s, e))
        used = sorted(r["__level"] for r in held.select("__level").distinct().collect())  # at most `levels` numbers
        p = points.withColumn("__level", F.explode(F.array(*[F.lit(u) for u in used]).cast("array<int>"))).withColumn("__b", slot(k, us(start)))
        i = held.withColumn("__b", F.explode(F.sequence(slot(k, us(s)), slot(k, us(e)))))
        after = us(start) > us(s) if strict else us(start) >= us(s)
        return cell_join(p, i, ["__level", "__b"], side).filter(after & (us(start) <= us(e))).drop("__level", "__b")

    x, y = a.filter(F.col(a_start) <= F.col(a_end)), b.filter(F.col(b_start) <= F.col(b_end))
    names = [*a.columns, *b.columns]
    return within(y, b_start, x, a_start, a_end, False).select(*names).unionByName(within(x, a_start, y, b_start, b_end, True).select(*names))


def evidence_at(anchors: DataFrame, evidence: DataFrame, anchor_key: str, at, start: str = "start_ts", end: str = "end_ts", offset: int = 0, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """JN-08: evidence of the anchors that contain an instant, in pages where a limit is asked for."""
    hit = anchors.filter((F.col(start) <= F.lit(at)) & (F.col(end) >= F.lit(at))).select(anchor_key)
    rows = evidence.join(hit, anchor_key, "left_semi")
    if order:
        rows = rows.orderBy(*order)
    return rows.offset(offset).limit(limit) if limit is not None else rows


def split_evidence(evidence: DataFrame, anchors: DataFrame, anchor_key: str) -> tuple[DataFrame, DataFrame]:
    """JN-09: evidence with an anchor, and the supporting rest."""
    return evidence.join(anchors.select(anchor_key), anchor_key, "left_semi"), evidence.filter(F.col(anchor_key).isNull()).unionByName(evidence.filter(F.col(anchor_key).isNotNull()).join(anchors.select(anchor_key), anchor_key, "left_anti"))


def count_per(left: DataFrame, right: DataFrame, key: str, id_col: str, name: str = "n") -> DataFrame:
    """JN-10, AG-37: how many right rows each left row has, 0 included; right rows are counted before they are joined."""
    n = right.groupBy(key).agg(F.count(id_col).alias(name))
    return left.join(n, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def correlations_of_runs(matches: DataFrame, results: DataFrame, executions: DataFrame, keep: Column, limit: int | None = 500) -> DataFrame:
    """JN-11, JN-12: matches with their result and run that satisfy a predicate, by time then score; a report of 500."""
    j = matches.join(results, "result_id").join(executions, "execution_id").filter(keep).orderBy("match_ts", F.col("score").desc(), "match_id")
    return j.limit(limit) if limit is not None else j


def records_with_names(records: DataFrame, names: DataFrame, info: DataFrame, key: str = "record_number") -> DataFrame:
    """JN-13: each record with its standard information and the name of the highest namespace; stream names (`:`) don't count."""
    w = Window.partitionBy(key).orderBy(F.col("namespace").desc(), "file_name")
    best = names.filter(~F.col("file_name").startswith(":")).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    return records.join(best, key, "left").join(info, key, "left")


def records_with_journal(records: DataFrame, journal: DataFrame, key: str = "record_number", frn: str = "frn", unique: list[str] | None = None, skip_zero: bool = True, order: list[str] | None = None) -> DataFrame:
    """JN-14: file records left-joined to journal events by the 48-bit record number; HIGH confidence where one matched."""
    mask = F.lit((1 << 48) - 1)
    events = journal.withColumn("__k", F.col(frn).cast("long").bitwiseAND(mask))
    events = events.filter("__k <> 0") if skip_zero else events
    j = records.join(events, F.col(key) == F.col("__k"), "left").withColumn("confidence", F.when(F.col("__k").isNotNull(), "HIGH").otherwise("MEDIUM")).drop("__k")
    return insert_or_ignore(j, unique, order) if unique else j


def insert_or_ignore(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """ST-04: of the rows of a key the first one stays, by `order` and then by all other columns (of equal rows any is the
    same); keys with a null never collide. Sums by key: a hot key's rows are narrowed down before they are shuffled."""
    has_null = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) == 1 if len(keys) > 1 else F.col(keys[0]).isNull()
    sortable = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    rank = [*(order or []), *[c for c in sortable if c not in (order or [])]]
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*[F.col(f"`{c}`") for c in rank])).alias("__row")
    kept = df.filter(~has_null).groupBy(*keys).agg(first).select("__row.*")
    return kept.unionByName(df.filter(has_null))


def enrich(base: DataFrame, dictionary: DataFrame, column: str, table: str, shown: str | None = None) -> DataFrame:
    """JN-15, JN-16: left join to (value, key, source), entries that came from the same table skipped; `value [key]`.
    Spark broadcasts the dictionary if its size allows."""
    d = dictionary.filter(F.col("source") != table).select(F.col("value").alias("__v"), F.col("key").alias(f"{column}_key"))
    j = base.join(d, F.col(column).cast("string") == F.col("__v"), "left").drop("__v")
    text = F.when(F.col(f"{column}_key").isNotNull(), F.concat(F.col(column).cast("string"), F.lit(" ["), F.col(f"{column}_key"), F.lit("]"))).otherwise(F.col(column).cast("string"))
    return j.withColumn(shown or f"{column}_shown", text)


def parent_paths(nodes: DataFrame, key: str = "id", parent: str = "parent_id", name: str = "name", root: int = 5) -> DataFrame:
    """JN-17: key, path: names from the root down, by pointer doubling: after k rounds a row knows 2^k ancestors.

    A chain ends at the root (`./`), at a parent that doesn't exist (`[Unknown Parent: n]`), or, if it runs in a circle,
    at `[Unknown]`. Each round is one equi-join; nothing is collected. Rounds go on until one ends
    no further chain: a chain of more than 2^k ancestors has some of just over 2^k, so only circles are left then.
    """
    named = nodes.select(F.col(key).cast("long").alias("id"), F.col(parent).cast("long").alias("up"), F.col(name).alias("path"))
    is_root = (F.col("id") == root) | (F.col("up") == F.col("id"))
    named = named.withColumn("path", F.when(F.col("id") == root, F.lit(".")).otherwise(F.col("path"))).withColumn("up", F.when(is_root, None).otherwise(F.col("up"))).withColumn("done", F.col("up").isNull())
    left = None
    while True:
        above = named.select(F.col("id").alias("a_id"), F.col("up").alias("a_up"), F.col("path").alias("a_path"), F.col("done").alias("a_done"))
        j = named.join(above, F.col("up") == F.col("a_id"), "left")
        lost = ~F.col("done") & F.col("a_id").isNull()
        step = j.select(
            "id",
            F.when(F.col("done") | lost | F.col("a_done"), None).otherwise(F.col("a_up")).alias("up"),
            F.when(F.col("done"), F.col("path")).when(lost, F.concat(F.lit("[Unknown Parent: "), F.col("up").cast("string"), F.lit("]/"), F.col("path"))).otherwise(F.concat_ws("/", "a_path", "path")).alias("path"),
            (F.col("done") | lost | F.coalesce("a_done", F.lit(False))).alias("done"),
        )
        named = written(step)
        before, left = left, named.filter("not done").count()
        if left in (0, before):
            break
    return named.select(F.col("id").alias(key), F.when(F.col("done"), F.col("path")).otherwise("[Unknown]").alias("path"))


def pair_scores(events: DataFrame, seconds: int, score: Column, least: float = 0.5, key: str = "event_id", ts: str = "ts", near: float = 1.0, alike: dict[str, float] | None = None, side: int = 10_000) -> DataFrame:
    """JN-18: pairs of events (each once) in a window whose score is high enough. `score` speaks of a_* and b_* columns.

    Where it is `near`, falling evenly to 0 at the window's end, plus a weight for each column of `alike` that is equal,
    only pairs that can reach `least` are met (close_pairs).
    """
    if alike:
        j = close_pairs(events, seconds, least, key, ts, near, alike, side)
    else:
        a = events.select(*[F.col(c).alias(f"a_{c}") for c in events.columns])
        b = events.select(*[F.col(c).alias(f"b_{c}") for c in events.columns])
        j = band_join(a, b, seconds, f"a_{ts}", f"b_{ts}", side=side).filter(F.col(f"a_{key}") < F.col(f"b_{key}"))
    return j.withColumn("score", score).filter(F.col("score") >= least)


def close_pairs(events: DataFrame, seconds: int, least: float, key: str, ts: str, near: float, alike: dict[str, float], side: int = 10_000) -> DataFrame:
    """Pairs within +-seconds that are near enough for what they have in common: see pair_scores.

    The fewer columns are equal, the nearer a pair must be. Pairs are of kinds: equal in the first column of `alike` (the
    most telling one goes first), or else in the second, and so on, or in none; no pair is of two. A kind has time buckets
    of its own reach and its column as a key. An event stands in its bucket to the left, and in its own and the one before
    to the right, so that two events meet once, or twice within a bucket, where the smaller key goes left.
    """
    names, place = list(alike), []
    for kind in range(len(names) + 1):
        far = min(1.0, 1.0 - (least - sum(alike[c] for c in names[kind:])) / near) * seconds * US
        if far > -1e-3:
            one = F.xxhash64(names[kind]) if kind < len(names) else F.lit(0).cast("long")
            # a microsecond for the rounding of scores; without a reach only events of an instant meet
            at = F.floor(F.col("__at") / (int(far) + 1)).alias("__bucket")
            steps = F.array(*[F.lit(x) for x in ((0, 1) if far >= 1e-3 else (0,))]).alias("__steps")
            at = F.struct(F.lit(kind).alias("__kind"), one.alias("__key"), at, steps)
            place.append(F.when(F.col(names[kind]).isNotNull(), at) if kind < len(names) else at)
    on, cols = ["__kind", "__key", "__bucket"], events.columns
    place = F.array(*place) if place else F.lit(None).cast("array<struct<__kind: int, __key: bigint, __bucket: bigint, __steps: array<int>>>")
    rows = events.withColumn("__at", us(ts)).filter("__at is not null")
    placed = rows.select(*cols, F.inline(F.filter(place, lambda x: x.isNotNull())))
    left = placed.select(*[F.col(c).alias(f"l_{c}") for c in cols], *on).hint("merge")  # its files are far smaller than its rows
    right = placed.select(*[F.col(c).alias(f"r_{c}") for c in cols], *on, F.explode("__steps").alias("__step")).withColumn("__bucket", F.col("__bucket") - F.col("__step"))
    # a bucket lies in two stretches of `seconds` at most, and with the one after it in three
    crowd = rows.groupBy(F.floor(F.col("__at") / (seconds * US + 1)).alias("b")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    j = left.join(right, on) if 3 * crowd <= side else cell_join(left, right, on, side)
    kind = F.lit(len(names))
    for k in reversed(range(len(names))):
        kind = F.when(F.col(f"l_{names[k]}") == F.col(f"r_{names[k]}"), k).otherwise(kind)
    gap = F.abs(us(f"l_{ts}") - us(f"r_{ts}"))
    less, more = F.col(f"l_{key}") < F.col(f"r_{key}"), F.col(f"l_{key}") > F.col(f"r_{key}")
    j = j.filter((gap <= seconds * US) & (less | ((F.col("__step") == 1) & more)) & (F.col("__kind") == kind))
    pick = lambda x, y, name: [F.when(less, F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{name}_{c}") for c in cols]
    return j.select(*pick("l", "r", "a"), *pick("r", "l", "b"), (gap / F.lit(float(US))).alias("dt_s"))


def find_fields(wanted: DataFrame, fields: DataFrame, aliases: DataFrame, fuzzy: bool = True) -> DataFrame:
    """JN-19: wanted(name), fields(field), aliases(name, alias) -> name, field by the best of: exact, case-free,
    separator-free, alias, and (fuzzy) at least half of the tokens in common; ties to the first in order."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    tokens = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != "")
    same = wanted.join(fields, plain(F.col("name")) == plain(F.col("field"))).withColumn("rank", F.when(F.col("name") == F.col("field"), 1).when(F.lower("name") == F.lower("field"), 2).otherwise(3))
    other = wanted.join(aliases, "name").join(fields, plain(F.col("alias")) == plain(F.col("field"))).withColumn("rank", F.lit(4)).select("name", "field", "rank")
    found = same.select("name", "field", "rank").unionByName(other)
    if fuzzy:
        x, y = wanted.withColumn("t", F.explode(tokens(F.col("name")))), fields.withColumn("t", F.explode(tokens(F.col("field"))))
        shared = x.join(y, "t").groupBy("name", "field").agg(F.count_distinct("t").alias("n"))
        near = shared.filter(F.col("n") * 2 >= F.greatest(F.size(tokens(F.col("name"))), F.size(tokens(F.col("field"))))).select("name", "field", F.lit(5).alias("rank"))
        found = found.unionByName(near)
    w = Window.partitionBy("name").orderBy("rank", "field")
    return found.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").select("name", "field", "rank")


def propagate(matches: DataFrame, processed: DataFrame, data: str = "semantic") -> DataFrame:
    """JN-20: data of (match_id, source, idx), else that of (match_id, source), for each record of a match."""
    exact = processed.select("match_id", "source", "idx", F.col(data).alias("__exact"))
    loose = processed.groupBy("match_id", "source").agg(F.min_by(data, "idx").alias("__loose"))
    return matches.join(exact, ["match_id", "source", "idx"], "left").join(loose, ["match_id", "source"], "left").withColumn(data, F.coalesce("__exact", "__loose")).drop("__exact", "__loose")
