"""Timestamp columns (TS-01..TS-15). All results are TimestampType instants under a UTC session zone, or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Seconds between the epochs of 1601, 1899-12-30 and 2001 and that of 1970.
FILETIME_SHIFT_S = 11_644_473_600
OLE_EPOCH_DAYS = 25_569
COCOA_EPOCH_S = 978_307_200

# String layouts in the order tried.
ISO_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd")
SLASH_LAYOUTS = ("yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy")
IMPORT_LAYOUTS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "dd-MM-yyyy HH:mm:ss", "dd-MM-yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd")

#: Named year gates of the numeric ladder: (least year, greatest year, None for two years from now).
PROFILES = {"timeline": (2000, None), "evidence": (1990, 2100), "wide": (1970, 2100)}


def _first_layout(text: Column, layouts: tuple[str, ...]) -> Column:
    """The first layout that fits. A pattern's shape is checked before it is parsed, since parsers differ on leniency."""
    return F.coalesce(*[F.when(F.length(text) == len(p.replace("'", "")), F.try_to_timestamp(text, F.lit(p))) for p in layouts])


def filetime_to_ts(x: Column) -> Column:
    """TS-01: 100 ns since 1601."""
    return F.timestamp_micros(F.floor(x.cast("decimal(20,0)") / 10).cast("long") - F.lit(FILETIME_SHIFT_S * 1_000_000))


def ts_to_filetime(ts: Column) -> Column:
    return (F.unix_micros(ts.cast("timestamp")) + F.lit(FILETIME_SHIFT_S * 1_000_000)) * 10


def systemtime_to_ts(raw: Column) -> Column:
    """TS-02: 16 bytes, eight little-endian 16-bit fields: year, month, weekday, day, hour, minute, second, ms."""

    def field(i: int) -> Column:
        lo, hi = F.hex(F.substring(raw, 2 * i + 1, 1)), F.hex(F.substring(raw, 2 * i + 2, 1))
        return F.conv(F.concat(hi, lo), 16, 10).cast("int")

    return F.when(F.length(raw) == 16, F.try_make_timestamp(field(0), field(1), field(3), field(4), field(5), field(6) + field(7) / F.lit(1000)))


def ts_to_systemtime(ts: Column) -> Column:
    pair = lambda x: F.concat(F.substring(F.lpad(F.hex(x), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(x), 4, "0"), 1, 2))
    ms = F.floor(F.unix_micros(ts) / 1000) % 1000
    parts = [F.year(ts), F.month(ts), F.dayofweek(ts) - 1, F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.second(ts), ms.cast("int")]
    return F.unhex(F.concat(*[pair(p.cast("long")) for p in parts]))


def unix_to_ts(x: Column) -> Column:
    """TS-03: seconds, milliseconds or microseconds, told apart by magnitude (years 2001 to 2100)."""
    v = x.cast("double")
    return (
        F.when(v.between(946_684_800, 4_102_444_800), F.timestamp_micros((v * 1_000_000).cast("long")))
        .when(v.between(946_684_800e3, 4_102_444_800e3), F.timestamp_micros((v * 1000).cast("long")))
        .when(v.between(946_684_800e6, 4_102_444_800e6), F.timestamp_micros(v.cast("long")))
    )


def epoch_days_to_ts(x: Column) -> Column:
    """TS-07"""
    return F.timestamp_micros((x.cast("double") * 86_400_000_000).cast("long"))


def in_years(ts: Column, least: int = 2000, most: int | None = None) -> Column:
    """TS-08: null outside the years; by default up to two years from now."""
    top = F.lit(most) if most is not None else F.year(F.current_date()) + 2
    return F.when(F.year(ts).between(F.lit(least), top), ts)


def _bound(value: Column, f) -> Column:
    """f of a value that is worked out once: long ladders would repeat its expression in every rung."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def numeric_to_ts(x: Column, profile: str = "timeline") -> Column:
    """The ladder for numbers: 100 ns or microseconds since 1601, ms and s since 1970, s since 2001, days since 1899."""
    return _bound(x.cast("double"), lambda v: _number_ladder(v, *PROFILES[profile]))


def _number_ladder(v: Column, least: int, most: int | None) -> Column:
    micros = lambda c: F.timestamp_micros(c.cast("long"))
    since_1601 = F.when(v > 1e17, v / 10).otherwise(v) - F.lit(FILETIME_SHIFT_S * 1_000_000)
    cocoa = _bound(micros((v + COCOA_EPOCH_S) * 1_000_000), lambda t: in_years(t, least, most))
    ole = micros((v - OLE_EPOCH_DAYS) * 86_400_000_000)
    ladder = (
        F.when(v > 1e15, micros(since_1601))
        .when(v > 1e12, micros(v * 1000))
        .when((v > 946_684_800) & (v < 2_524_608_000), micros(v * 1_000_000))
        .when((v > 0) & (v < 1_500_000_000), F.coalesce(cocoa, F.when((v > 36_526) & (v < 60_000) & (v != F.floor(v)), ole)))
    )
    return _bound(ladder, lambda t: in_years(t, least, most))


def parse_any(x: Column, profile: str = "timeline") -> Column:
    """TS-04: strings in ISO layouts, then anything the engine's own parser takes, then numbers in strings."""
    gate = PROFILES[profile]

    def parsed(text: Column) -> Column:
        number = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), text.try_cast("double"))
        said = F.when(number.isNull(), F.coalesce(_first_layout(text, ISO_LAYOUTS), F.try_to_timestamp(text)))
        return F.coalesce(_bound(said, lambda t: in_years(t, *gate)), _bound(number, lambda v: _number_ladder(v, *gate)))

    return _bound(F.trim(x.cast("string")), lambda t: F.when((t != "") & (t != "N/A"), parsed(t)))


def parse_slash(x: Column) -> Column:
    """TS-06: slash dates, US order before EU order."""
    return _bound(F.trim(x.cast("string")), lambda t: _first_layout(t, SLASH_LAYOUTS))


def detect_format(x: Column) -> Column:
    """TS-09: the name of a raw value's time format, `unknown` if none."""
    return _bound(F.trim(x.cast("string")), lambda text: _bound(F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double")), lambda v: _format_of(text, v)))


def _format_of(text: Column, v: Column) -> Column:
    return (
        F.when(text.isNull() | (text == ""), F.lit("empty"))
        .when(v > 1e17, "filetime").when(v > 1e15, "webkit_us").when(v.between(946_684_800e6, 4_102_444_800e6), "unix_us")
        .when(v.between(946_684_800e3, 4_102_444_800e3), "unix_ms").when(v.between(946_684_800, 4_102_444_800), "unix_s")
        .when(v.between(36_526, 60_000), "ole_days").when(v.isNotNull(), "unknown")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), "iso8601").when(text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:"), "sql")
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date").when(text.rlike(r"^\d{4}/\d{2}/\d{2}"), "slash_ymd")
        .when(text.rlike(r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4}"), "slash_us").when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), "slash_eu")
        .otherwise("unknown")
    )


def parse_resilient(x: Column, hint: str | None = None, profile: str = "evidence") -> Column:
    """TS-05: struct(ts, format, confidence). A layout given as hint is tried first and trusted most."""
    text = F.trim(x.cast("string"))
    hinted = F.try_to_timestamp(text, F.lit(hint)) if hint else F.lit(None).cast("timestamp")
    found = F.coalesce(parse_any(x, profile), _bound(parse_slash(x), lambda t: in_years(t, *PROFILES[profile])))
    parts = F.struct(hinted.alias("hinted"), F.coalesce(hinted, found).alias("ts"), detect_format(x).alias("kind"))

    def told(p: Column) -> Column:
        sure = F.when(p["hinted"].isNotNull(), 1.0).when(p["ts"].isNull(), 0.0).when(p["kind"].isin("slash_us", "slash_eu", "unknown"), 0.7).otherwise(0.95)
        return F.struct(p["ts"].alias("ts"), F.when(p["hinted"].isNotNull(), F.lit("hint")).otherwise(p["kind"]).alias("format"), sure.alias("confidence"))

    return _bound(parts, told)


def to_utc(ts: Column, zone: str) -> Column:
    """TS-10: a wall-clock time of a zone as an instant."""
    return F.to_utc_timestamp(ts, zone)


def display(ts: Column, layout: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(ts, layout)


def explode_times(df: DataFrame, column: str, keep: str = "all_times") -> DataFrame:
    """TS-11: a cell holding a JSON array of times becomes one row a time, the original kept; other rows stay one row."""
    cell = F.trim(F.col(column).cast("string"))
    many = F.when(cell.startswith("["), F.from_json(cell, "array<string>"))
    return df.withColumn(keep, F.col(column)).withColumn(column, F.explode(F.when(F.size(many) > 0, many).otherwise(F.array(F.col(column).cast("string")))))


def first_time(columns: list[Column], profile: str = "evidence") -> Column:
    """TS-12: the first of several raw columns that parses."""
    return F.coalesce(*[parse_any(c, profile) for c in columns])


def time_bounds(df: DataFrame, column: str) -> DataFrame:
    """TS-13"""
    return df.agg(F.min(column).alias("first_ts"), F.max(column).alias("last_ts"))


def event_time_by_family(family: Column, fields: dict[str, list[Column]]) -> Column:
    """TS-14: each artifact family has its own ordered list of time columns; null for other families."""
    return reduce(lambda c, f: c.when(family == f, F.coalesce(*fields[f])), list(fields)[1:], F.when(family == next(iter(fields)), F.coalesce(*fields[next(iter(fields))])))


def import_time(x: Column) -> Column:
    """TS-15: the import layouts; null where none fits or the value is empty (the raw text stays in its own column)."""
    return _first_layout(x.cast("string"), IMPORT_LAYOUTS)


def floor_us(ts: Column, seconds: int) -> Column:
    """The number of the epoch-aligned slice of so many seconds that an instant lies in."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
