"""Edge cases of column functions: small tables with expected values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evspark.functions import predicates as P
from evspark.functions import textfn as X
from evspark.functions import timefn as TS


def one(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v")).cast("string")).collect()]


def test_parse_any(spark):
    got = one(spark, ["2024-01-02 03:04:05", "2024-01-02T03:04:05Z", "1704164645", "1704164645000", "133486382450000000", "45293.5", "725857445", "N/A", "", None, "1899-01-01", "abc"], TS.parse_any)
    day = "2024-01-02 03:04:05"
    assert got == [day, day, day, day, day, "2001-01-01 12:34:53.5", day, None, None, None, None, None]


def test_parse_slash_prefers_us(spark):
    assert one(spark, ["03/04/2020", "25/12/2020", "2020/01/02 03:04:05", "x"], TS.parse_slash) == ["2020-03-04 00:00:00", "2020-12-25 00:00:00", "2020-01-02 03:04:05", None]


def test_base_and_suffix(spark):
    raw = ["Conference-LaTeX-template-UD23.09.2024", "chrome_v120.0.1", "document (2)", "Report_2024-01-15", "tool x64", "a - Copy (2)", "plain", "", None]
    assert one(spark, raw, lambda c: F.concat_ws("|", X.base_and_suffix(c)["base"], X.base_and_suffix(c)["suffix"]))[:7] == ["Conference LaTeX template UD|23.09.2024", "chrome|v120.0.1", "document|(2)", "Report|2024-01-15", "tool|x64", "a Copy|(2)", "plain|"]


def test_app_key(spark):
    raw = ["Chrome.exe", "BRAVE.EXE 3118B3E3.pf", "CHROME~1.EXE", "app (3)", "file - Copy 2", "Tool v1.2", "123.exe", "", None]
    assert one(spark, raw, X.app_key) == ["chrome", "brave", "chrome", "app", "file", "tool", "123exe", "", None]


def test_scan_identity(spark):
    assert one(spark, ["Program (x86)", "The chrome.exe", "app v2.0", "app app of"], X.scan_identity) == ["program", "chrome", "app", "app app"]


def test_parse_num(spark):
    got = [float(x) for x in one(spark, ["5 MB", "1h 3m", "1,024", "500 ms", "junk", "unknown", "", None, "2.5 KB"], X.parse_num)]
    assert got == [5 * 1024**2, 3780.0, 1024.0, 0.5, 0.0, 0.0, 0.0, 0.0, 2560.0]


def test_flags(spark):
    assert one(spark, ["3", "0", "2147483648", "x", None], lambda c: X.flags_to_text(c, X.CHANGE_REASONS, "NONE")) == ["DATA_OVERWRITE|DATA_EXTEND", "NONE", "CLOSE", "x", None]


def test_identity_problem(spark):
    assert one(spark, ["", " ", "yes", "12", "C:", "x", "!!", "ok", None], X.identity_problem) == ["empty_value", "whitespace_only", "boolean_string", "numeric_value", None, "too_short", "no_alphanumeric", None, "empty_value"]


@pytest.mark.parametrize(("pattern", "text", "fits"), [("a*", "ABC", True), ("a?c", "abc", True), ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("a.c", "abc", False), ("*", "", True)])
def test_globs(spark, pattern, text, fits):
    assert spark.range(1).select(P.identity_glob([F.lit(text)], [pattern])).first()[0] is fits


def test_conditions_never_null(spark):
    df = spark.createDataFrame([(None, None), ("a", "1")], "a string, b string")
    for op, v in (("equals", "A"), ("!=", "x"), ("contains", "a"), ("regex", "^a"), ("wildcard", ""), ("in", "a,b")):
        assert [r[0] for r in df.select(P.condition(F.col("a"), op, v)).collect()] == [False, True]
    assert [r[0] for r in df.select(P.condition(F.col("b"), ">=", 1)).collect()] == [False, True]
    with pytest.raises(ValueError):
        P.condition(F.col("a"), "about", "x")


def test_explode_times(spark):
    df = spark.createDataFrame([(1, '["2024-01-01","2024-01-02"]'), (2, "2024-01-03"), (3, None), (4, "[]")], "i int, t string")
    got = sorted((r["i"], r["t"]) for r in TS.explode_times(df, "t").select("i", F.coalesce("t", F.lit("-")).alias("t")).collect())
    assert got == [(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-03"), (3, "-"), (4, "[]")]


def test_systemtime(spark):
    df = spark.createDataFrame([(datetime(2024, 2, 29, 1, 2, 3, 456000),)], "t timestamp")
    assert df.select(TS.systemtime_to_ts(TS.ts_to_systemtime(F.col("t")))).first()[0] == datetime(2024, 2, 29, 1, 2, 3, 456000)
