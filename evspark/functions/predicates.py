"""Row predicates and the rule compiler (FLT-01..FLT-20). Each returns a boolean Column that is never null unless said."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

no = lambda c: F.coalesce(c, F.lit(False))


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def like_of(pattern: str) -> str:
    """A `*` wildcard as an SQL LIKE pattern, with LIKE's own marks escaped."""
    return re.sub(r"([\\%_])", r"\\\1", pattern).replace("*", "%")


def matches(x: Column, pattern: str) -> Column:
    """FLT-01: equality, or a `*` wildcard without regard to case."""
    return no(x.ilike(like_of(pattern)) if "*" in pattern else x == pattern)


def excludes(x: Column, pattern: str) -> Column:
    """FLT-02: null rows drop out, as in SQL."""
    return no(~x.ilike(like_of(pattern)) if "*" in pattern else x != pattern)


def in_list(x: Column, items: str) -> Column:
    """FLT-03: membership in a comma-separated list."""
    return no(x.cast("string").isin(*[i.strip() for i in items.split(",")]))


def regex_at_start(x: Column, pattern: str) -> Column:
    """FLT-04"""
    return no(x.rlike(f"^(?:{pattern})"))


def in_range(ts: Column, start, end) -> Column:
    """FLT-05: both ends inclusive; the column stays bare, so that the scan can prune."""
    return no(ts.between(F.lit(start), F.lit(end)))


def any_in_range(columns: Sequence[Column], start, end) -> Column:
    """FLT-06"""
    return any_of([in_range(c, start, end) for c in columns])


def in_period(ts: Column, start, end, keep_null: bool = False) -> Column:
    """FLT-08, FLT-09: rows without a time go, or stay."""
    return ts.isNull() | in_range(ts, start, end) if keep_null else in_range(ts, start, end)


def glob_regex(pattern: str, case: bool = False) -> str:
    """`* ? [abc] [!abc]` as an anchored regular expression."""
    out = []
    for part in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, re.S):
        if part == "*":
            out.append(".*")
        elif part == "?":
            out.append(".")
        elif len(part) > 2:
            out.append("[^" + part[2:] if part[1] == "!" else part)
        else:
            out.append(re.escape(part))
    return ("(?s)" if case else "(?is)") + "^(?:" + "".join(out) + ")$"


def identity_glob(columns: Sequence[Column], patterns: Sequence[str], case: bool = False, keep_if_none: bool = False) -> Column:
    """FLT-10: any pattern fits any identity column. FLT-11: keep_if_none keeps rows without any identity."""
    hit = any_of([no(c.rlike(glob_regex(p, case))) for p in patterns for c in columns]) if patterns else F.lit(True)
    return hit | F.coalesce(*columns).isNull() if keep_if_none else hit


def filter_statistics(df: DataFrame, keep: Column, source: str) -> DataFrame:
    """FLT-12: rows before, after and removed for each source."""
    n, kept = F.count(F.lit(1)), F.count_if(keep)
    return df.groupBy(source).agg(n.alias("before"), kept.alias("after"), (n - kept).alias("removed"))


#: FLT-13, FLT-15: operators of one condition. Text compares without case; numbers where both sides are numbers.
def condition(x: Column, operator: str, value="") -> Column:
    text, number = F.lower(x.cast("string")), x.try_cast("double")
    v = str(value)
    if operator in ("equals", "=", "=="):
        return no(text == v.lower())
    if operator in ("not_equals", "!="):
        return no(text != v.lower())
    if operator == "contains":
        return no(text.contains(v.lower()))
    if operator == "regex":
        re.compile(v)  # a pattern that can't be read fails here, on the driver
        return no(x.cast("string").rlike(f"(?i){v}"))
    if operator == "wildcard":  # any value at all
        return no(text != "")
    if operator == "in":
        return no(text.isin(*[str(i).strip().lower() for i in (value if isinstance(value, (list, tuple)) else v.split(","))]))
    compare = {">": Column.__gt__, "<": Column.__lt__, ">=": Column.__ge__, "<=": Column.__le__, "greater_than": Column.__gt__, "less_than": Column.__lt__}.get(operator)
    if compare is None:
        raise ValueError(f"no such operator: {operator}")
    return no(compare(number, F.lit(float(v))))


def conditions(parts: Sequence[Mapping], logic: str = "AND", field=F.col) -> Column:
    """FLT-14, FLT-15: conditions combined by AND or OR; a leading {"logic": "OR"} switches to OR."""
    if parts and "logic" in parts[0] and "field" not in parts[0]:
        logic, parts = parts[0]["logic"], parts[1:]
    made = [condition(field(p["field"]), p["operator"], p.get("value", "")) for p in parts]
    return any_of(made) if logic.upper() == "OR" else all_of(made)


# FLT-17: predicates of a change journal


def reason_has(reason: Column, name: str) -> Column:
    return no(F.upper(reason).contains(name.upper()))


def is_deleted_event(reason: Column) -> Column:
    return reason_has(reason, "DELETE")


def is_created_event(reason: Column) -> Column:
    return reason_has(reason, "CREATE")


def is_renamed_event(reason: Column) -> Column:
    return reason_has(reason, "RENAME")


def file_history(df: DataFrame, name: str, name_col: str = "filename", ts: str = "timestamp") -> DataFrame:
    return df.filter(no(F.col(name_col).ilike(like_of(f"*{name}*")))).orderBy(ts)


# FLT-18, FLT-19: predicates of a file table and of the table joined to its journal


def is_deleted_record(flags: Column) -> Column:
    """The in-use bit isn't set."""
    return no(flags.cast("long").bitwiseAND(F.lit(1)) == 0)


def is_deleted_joined(flags: Column, reason: Column) -> Column:
    return is_deleted_record(flags) | is_deleted_event(reason)


def score_band(score: Column, least: float = 0.0, most: float = 1.0) -> Column:
    return no(score.between(least, most))


def times_disagree(a: Column, b: Column, seconds: int = 86_400) -> Column:
    """FLT-20"""
    gap = F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp")))
    return no(gap > F.lit(seconds * 1_000_000))
