"""Window correlation, match scores, duplicates and checks (CW-01..05, SC-01..09, DUP-01..03, VAL-01..02)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.operators.joins import US, config_table, us


@dataclass(frozen=True)
class CorrelationSpec:
    """What to correlate: window and step in minutes, how many sources a group needs, weights of sources."""

    window_minutes: int = 180
    step_minutes: int | None = None
    min_sources: int = 2
    min_other_sources: int = 1
    weights: dict[str, float] = field(default_factory=dict)
    anchor_priority: tuple[str, ...] = ()


def windows(df: DataFrame, ts: str, size_s: int, step_s: int | None = None, origin_us: int | Column = 0, closed: str = "left", end_us: int | Column | None = None) -> DataFrame:
    """CW-01: each row once for every scan window [k * step, k * step + size) it lies in; closed="both" takes a row on
    a window's end too. Windows come from rows, so none is empty; the last is cut at the end of the data."""
    size, step = size_s * US, (step_s or size_s) * US
    o = F.lit(origin_us) if isinstance(origin_us, int) else origin_us
    t = us(ts) - o
    last = F.floor(t / step)
    first = F.ceil((t - size) / step) if closed == "both" else F.floor((t - size) / step) + 1
    rows = df.filter(F.col(ts).isNotNull()).withColumn("__k", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    end = F.col("__k") * step + size + o
    if end_us is not None:
        end = F.least(end, F.lit(end_us) if isinstance(end_us, int) else end_us)
    return rows.withColumn("window_start", F.timestamp_micros(F.col("__k") * step + o)).withColumn("window_end", F.timestamp_micros(end)).drop("__k")


def correlate_windows(df: DataFrame, identity: str, source: str, ts: str, min_sources: int = 2) -> DataFrame:
    """CW-02: groups of (window, identity) with enough sources, exact repeats of (identity, source, time) counted once.

    One shuffle: rows are dealt by (window, identity), and the three aggregates on longer keys - repeats, sources,
    groups - find their rows together in the same partitions.
    """
    rows = df.filter(F.col(identity).isNotNull()).select("window_start", identity, source, ts).repartition("window_start", identity)
    once = rows.groupBy("window_start", identity, source, ts).agg(F.lit(1).alias("__one"))
    per = once.groupBy("window_start", identity, source).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    out = per.groupBy("window_start", identity).agg(
        F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("n_records"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), F.array_sort(F.collect_list(source)).alias("sources")
    )
    return out.filter(F.col("n_sources") >= min_sources)


def view_windows(matches: DataFrame, ts: str, size_s: int) -> DataFrame:
    """CW-04: matches in viewing windows counted from 2000-01-01."""
    origin = 946_684_800 * US
    k = F.floor((us(ts) - origin) / (size_s * US))
    return matches.withColumn("view_start", F.timestamp_micros(k * (size_s * US) + origin))


def view_filter(df: DataFrame, text: str | None = None, source: str | None = None, lo=None, hi=None, identity: str = "identity", sources: str = "sources", tags: str | None = None, start: str = "first_ts", end: str = "last_ts") -> DataFrame:
    """CW-05: text in the identity or a tag, a source, and overlap with a range."""
    if text:
        hit = F.col(identity).ilike(f"%{text}%")
        if tags:
            hit = hit | F.exists(tags, lambda t: t.ilike(f"%{text}%"))
        df = df.filter(F.coalesce(hit, F.lit(False)))
    if source:
        df = df.filter(F.array_contains(sources, source))
    if lo is not None:
        df = df.filter((F.col(end) >= F.lit(lo)) & (F.col(start) <= F.lit(hi)))
    return df


def window_states(matches: DataFrame, start: str, size_s: int, status: str = "all") -> DataFrame:
    """CW-05: start, n_identities of every window from the first to the last, gaps included; `data` or `empty` ones alone
    where asked for. Each window that has data adds the empty ones up to the next."""
    width = size_s * US
    per = matches.groupBy(us(start).alias("at")).agg(F.count(F.lit(1)).alias("n_identities"))
    order = Window.partitionBy("block").orderBy("at")
    per = per.withColumn("block", F.floor(F.col("at") / (width * 1024)))  # windows of a block are neighbours; blocks are stitched by their first ones
    firsts = per.groupBy("block").agg(F.min("at").alias("first")).withColumn("following", F.lead("first").over(Window.orderBy("block")))  # one row a block
    per = per.join(firsts, "block").withColumn("upto", F.coalesce(F.lead("at").over(order), "following", F.col("at") + width))
    every = per.select("n_identities", F.posexplode(F.sequence("at", F.col("upto") - 1, F.lit(width))).alias("pos", "window_us"))
    out = every.select(F.timestamp_micros("window_us").alias("window_start"), F.when(F.col("pos") == 0, F.col("n_identities")).otherwise(0).alias("n_identities"))
    return {"all": out, "data": out.filter("n_identities > 0"), "empty": out.filter("n_identities = 0")}[status]


# scores


def share_of_mode(values: Column) -> Column:
    """The count of an array's most common value (nulls left out)."""
    kept = F.filter(F.transform(values, lambda v: F.lower(v)), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(F.array_max(F.transform(F.array_distinct(kept), lambda v: F.size(F.filter(kept, lambda w: w == v)))), F.lit(0))


def match_score(n_sources: Column, total_sources: int, spread_s: Column, window_s: int, apps: Column, paths: Column) -> Column:
    """SC-01, SC-09: struct(score, coverage, time_proximity, field_similarity)."""
    coverage = n_sources / F.lit(float(total_sources)) if total_sources else F.lit(0.0)
    near = F.exp(-spread_s / F.lit(float(window_s))) if window_s else F.lit(1.0)
    alike = F.when(n_sources > 0, (share_of_mode(apps) + share_of_mode(paths)) / (n_sources * F.lit(2.0))).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.4) * coverage + F.lit(0.3) * near + F.lit(0.3) * alike))
    return F.struct(score.alias("score"), F.bround(coverage, 4).alias("coverage"), F.bround(near, 4).alias("time_proximity"), F.bround(alike, 4).alias("field_similarity"))


def match_confidence(spread_s: Column, window_s: int, apps: Column, paths: Column) -> Column:
    """SC-02: struct(confidence, category)."""
    tight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - spread_s / F.lit(float(window_s)))) if window_s else F.lit(1.0)

    def agrees(values):
        n = F.size(F.filter(values, lambda v: v.isNotNull() & (v != "")))
        return F.when(n > 0, (share_of_mode(values) >= n * F.lit(0.8)).cast("int")), F.when(n > 0, 1).otherwise(0)

    (a, has_a), (p, has_p) = agrees(apps), agrees(paths)
    fields = has_a + has_p
    same = F.when(fields > 0, (F.coalesce(a, F.lit(0)) + F.coalesce(p, F.lit(0))) / fields).otherwise(0.0)
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) * tight + F.lit(0.5) * same))
    return F.struct(c.alias("confidence"), F.when(c > 0.8, "High").when(c >= 0.5, "Medium").otherwise("Low").alias("category"))


def effective_weights(sources: DataFrame, wing: DataFrame, case: DataFrame, world: DataFrame, default: float = 0.1) -> DataFrame:
    """SC-06: source, weight: the wing's if above 0, else the case's, else the global one, else 0.1; the last two go by
    artifact type. Inputs are config tables (source, artifact_type), (source, weight), (artifact_type, weight)."""
    j = sources.join(wing.select("source", F.col("weight").alias("w1")), "source", "left").join(case.select("artifact_type", F.col("weight").alias("w2")), "artifact_type", "left").join(world.select("artifact_type", F.col("weight").alias("w3")), "artifact_type", "left")
    return j.select("source", F.coalesce(F.when(F.col("w1") > 0, F.col("w1")), F.col("w2"), F.col("w3"), F.lit(default)).alias("weight"))


def weighted_score(members: DataFrame, key: list[str], source: str, weights: DataFrame, labels: list[tuple[float, str]], default: float = 0.0) -> DataFrame:
    """SC-03: sum of the weights of the sources present, its breakdown, and the label with the highest least reached."""
    j = members.select(*key, source).distinct().join(config_table(weights.withColumnRenamed("source", source)), source, "left").withColumn("weight", F.coalesce("weight", F.lit(default)))
    out = j.groupBy(*key).agg(F.bround(F.sum("weight"), 2).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(source).alias("k"), "weight")))).alias("breakdown"))
    return out.withColumn("label", label_of(F.col("score"), labels))


def label_of(score: Column, labels: list[tuple[float, str]], other: str = "Unknown") -> Column:
    c = F.lit(other)
    for least, name in sorted(labels):
        c = F.when(score >= least, name).otherwise(c)
    return c


# Thresholds of the interpretations and tiers.
INTERPRETATION = [(0.9, "Critical"), (0.7, "High"), (0.5, "Medium"), (0.3, "Low")]
RATIO_LABELS = [(80.0, "Strong"), (50.0, "Good"), (25.0, "Weak")]
TIERS = [(0.8, "1"), (0.5, "2"), (0.2, "3")]


def simple_scores(n: Column, total: int) -> Column:
    """SC-04: struct(count, ratio, label): the count and the percentage under their own names."""
    pct = n * F.lit(100.0) / F.lit(float(total))
    return F.struct(n.alias("count_score"), (n / F.lit(float(total))).alias("ratio_score"), label_of(pct, RATIO_LABELS, "Minimal").alias("label"))


def interpret(score: Column) -> Column:
    """SC-05: struct(level, tier)."""
    return F.struct(label_of(score, INTERPRETATION, "Minimal").alias("level"), label_of(score, TIERS, "4").cast("int").alias("tier"))


def rescore(matches: DataFrame, members: DataFrame, key: str, source: str, weights: DataFrame, labels: list[tuple[float, str]]) -> DataFrame:
    """SC-07: stored matches with scores computed anew from their members."""
    new = weighted_score(members, [key], source, weights, labels).drop("breakdown")
    return matches.drop("score", "label").join(new, key, "left")


def pair_score(a_ts: str, b_ts: str, seconds: int, same_app: Column, same_path: Column, same_type: Column) -> Column:
    """SC-08: half for nearness in time, 0.2 for the program, 0.2 for the path, 0.1 for the type."""
    gap = F.abs(us(a_ts) - us(b_ts)) / F.lit(float(US))
    near = F.when(gap <= seconds, F.lit(0.5) * (F.lit(1.0) - gap / F.lit(float(seconds)))).otherwise(0.0)
    bonus = lambda c, w: F.when(c, w).otherwise(0.0)
    return F.least(near + bonus(same_app, 0.2) + bonus(same_path, 0.2) + bonus(same_type, 0.1), F.lit(1.0))


# duplicates and checks


def match_hash(members: DataFrame, match: str, anchor: str, source: str, row: str) -> DataFrame:
    """match, content hash: the anchor and the sorted (source, row) pairs."""
    text = F.concat_ws(":", F.col(source), F.col(row).cast("string"))
    return members.groupBy(match, anchor).agg(F.sha2(F.concat_ws("|", F.col(anchor).cast("string"), F.array_join(F.array_sort(F.collect_set(text)), "|")), 256).alias("match_hash"))


def flag_duplicates(hashed: DataFrame, match: str, order: list[str] | None = None) -> DataFrame:
    """DUP-01: is_duplicate, original id, and how many duplicates the original has."""
    w = Window.partitionBy("match_hash")
    o = w.orderBy(*(order or [match]))
    return hashed.withColumn("is_duplicate", F.row_number().over(o) > 1).withColumn("original_id", F.first(match).over(o)).withColumn("n_duplicates", F.count(F.lit(1)).over(w) - 1)


def distinct_records(df: DataFrame, anchor: list[str], fields: list[str]) -> DataFrame:
    """DUP-02"""
    return df.dropDuplicates([*anchor, *fields])


def distinct_content(df: DataFrame, lineage: list[str], keep_by: str) -> DataFrame:
    """DUP-03: rows equal in all but lineage columns count once; the smallest key stays."""
    content = [c for c in df.columns if c not in lineage and c != keep_by]
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in content]), 256)
    first = df.withColumn("__h", h).groupBy("__h").agg(F.min(keep_by).alias(keep_by))
    return df.join(first.select(keep_by), keep_by, "left_semi")


def within_window(members: DataFrame, match: str, anchor_ts: str, ts: str, seconds: int, min_members: int) -> DataFrame:
    """VAL-01: members too far from the anchor or without a time go; matches left with too few go too."""
    kept = members.filter(F.coalesce(F.abs(us(ts) - us(anchor_ts)) <= seconds * US, F.lit(False)))
    enough = kept.groupBy(match).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_members)
    return kept.join(enough.select(match), match, "left_semi")


def match_problems(n_members: Column, has_anchor: Column, score: Column, spread_s: Column, measured_s: Column) -> Column:
    """VAL-02: what is wrong with a match, an empty array if nothing."""
    checks = {"no_members": F.coalesce(n_members, F.lit(0)) < 1, "anchor_missing": ~F.coalesce(has_anchor, F.lit(False)), "score_out_of_range": ~F.coalesce(score.between(0.0, 1.0), F.lit(False)), "spread_differs": F.coalesce(F.abs(spread_s - measured_s) > 0.01, F.lit(True))}
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
