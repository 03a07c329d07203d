"""Schema inference and column roles (INF-03..INF-10)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.timefn import detect_format, parse_any

# Words in names that point to, or away from, times.
TIME_WORDS = ("timestamp", "time", "date", "created", "modified", "accessed", "last_run", "executed", "_ts", "ts")
OTHER_WORDS = ("id", "count", "size", "length", "duration", "timezone", "hash", "version")


def looks_like_time(column: str) -> bool:
    c = column.lower()
    return (any(w in c for w in TIME_WORDS[:-1]) or c == "ts") and not any(c == w or c.endswith(f"_{w}") or c.startswith(f"{w}_") for w in OTHER_WORDS)


def time_rates(df: DataFrame, columns: Sequence[str], sample: int = 100, profile: str = "evidence") -> DataFrame:
    """column, n, rate, format, format_share: how many of a sample's filled values are times: one aggregate for all
    columns over `sample` rows (the feature's own bound)."""
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).limit(sample)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in columns])).alias("p")).select("p.column", "p.v").filter("v is not null")
    per = long.groupBy("column", detect_format(F.col("v")).alias("format")).agg(F.count(F.lit(1)).alias("n"), F.count(parse_any(F.col("v"), profile)).alias("ok"))
    return per.groupBy("column").agg(F.sum("n").alias("n"), (F.sum("ok") / F.sum("n")).alias("rate"), F.max_by("format", F.struct("n", "format")).alias("top"), (F.max("n") / F.sum("n")).alias("format_share"))


def time_columns(df: DataFrame, sample: int = 100, least: float = 0.8, override: Sequence[str] = ()) -> DataFrame:
    """INF-03: candidates by name whose values are times at 80 % or more; the format is the dominant one or `mixed`. An
    override wins."""
    names = list(override) or [c for c in df.columns if looks_like_time(c)]
    got = time_rates(df, names or df.columns[:1], sample)
    fit = got.withColumn("format", F.when(F.col("format_share") >= 0.8, F.col("top")).otherwise("mixed")).select("column", "rate", "format")
    return fit if override else fit.filter((F.col("rate") >= least) & F.lit(bool(names)))


def any_time_columns(df: DataFrame, sample: int = 100, least: float = 0.7) -> DataFrame:
    """INF-04: any column but ids, counts and sizes, best rate first."""
    names = [c for c in df.columns if not any(w in c.lower() for w in ("id", "count", "size", "length"))]
    return time_rates(df, names, sample).filter(F.col("rate") >= least).orderBy(F.col("rate").desc(), "column").select("column", "rate")


def priority_time_columns(df: DataFrame, patterns: Sequence[str], sample: int = 100, least: float = 0.5) -> DataFrame:
    """INF-05: candidates in the order of name patterns, then by rate."""
    names = [c for c in df.columns if any(p in c.lower() for p in patterns)]
    rank = {c: next(i for i, p in enumerate(patterns) if p in c.lower()) for c in names}
    got = time_rates(df, names, sample).filter(F.col("rate") >= least)
    r = F.element_at(F.create_map(*[F.lit(x) for k in rank.items() for x in k]), F.col("column"))
    return got.withColumn("rank", r).orderBy("rank", F.col("rate").desc(), "column").select("column", "rank", "rate")


def type_by_table(table: Column, exact: Mapping[str, str], partial: Mapping[str, str]) -> Column:
    """INF-06: struct(type, confidence): exact names are high, parts of names medium, else Unknown and low."""
    t, kind, sure = F.lower(table), F.lit("Unknown"), F.lit("low")
    for p, k in reversed(partial.items()):
        kind, sure = F.when(t.contains(p.lower()), k).otherwise(kind), F.when(t.contains(p.lower()), "medium").otherwise(sure)
    for p, k in exact.items():
        kind, sure = F.when(t == p.lower(), k).otherwise(kind), F.when(t == p.lower(), "high").otherwise(sure)
    return F.struct(kind.alias("type"), sure.alias("confidence"))


def type_by_columns(columns: Column, signatures: Mapping[str, Sequence[str]]) -> Column:
    """INF-07: struct(share, type): the signature of which most columns are present; ties by name."""
    lower = F.transform(columns, lambda c: F.lower(c))
    each = [F.struct((F.size(F.array_intersect(lower, F.array(*[F.lit(c.lower()) for c in sig]))) / F.lit(len(sig))).alias("share"), F.lit(k).alias("type")) for k, sig in signatures.items()]
    return F.array_max(F.array(*each))


def type_by_file(path: Column, names: Mapping[str, str]) -> Column:
    """INF-08: separators stripped, then parts of the file name."""
    f = F.regexp_replace(F.lower(F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)), r"[\s_.-]", "")
    kind = F.lit("Unknown")
    for p, k in reversed(names.items()):
        kind = F.when(f.contains(p.lower()), k).otherwise(kind)
    return kind


def type_by_suffix(name: Column, rules: Sequence[tuple[str, str]], other: str = "Unknown") -> Column:
    """INF-09: the first regex that fits the name."""
    kind = F.lit(other)
    for p, k in reversed(rules):
        kind = F.when(name.rlike(f"(?i){p}"), k).otherwise(kind)
    return kind


def combined_type(metadata: Column, by_table: Column, by_file: Column, by_columns: Column) -> Column:
    """INF-10: struct(type, confidence): metadata 1.0; table name 0.9 or 0.7; file name 0.8; columns 0.7 x share from a
    share of 0.5; the surest wins, at a
    tie the one named first."""
    pick = lambda c, t, p, order: F.struct(F.when(c, p).otherwise(0.0).alias("confidence"), F.lit(order).alias("order"), F.when(c, t).otherwise("Unknown").alias("type"))
    known = lambda t: F.coalesce(t != "Unknown", F.lit(False))
    options = F.array(
        pick(metadata.isNotNull(), metadata, F.lit(1.0), 4), pick(known(by_table["type"]), by_table["type"], F.when(by_table["confidence"] == "high", 0.9).otherwise(0.7), 3),
        pick(known(by_file), by_file, F.lit(0.8), 2), pick(F.coalesce(by_columns["share"] >= 0.5, F.lit(False)), by_columns["type"], by_columns["share"] * 0.7, 1),
    )
    best = F.array_max(options)
    return F.struct(best["type"].alias("type"), best["confidence"].alias("confidence"))
