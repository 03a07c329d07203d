"""Sources, sinks and ingestion (SRC-01..16, SNK-01..04)."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITERS = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
LINEAGE = ("artifact_id", "source_tool", "collection_timestamp", "primary_timestamp", "artifact_type", "source_path")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", equal: dict | None = None, **options) -> DataFrame:
    """SRC-01: a table by path (or JDBC by options), with equality filters that the scan takes over. SRC-06: for SQLite files
    see sources.sqlite."""
    df = spark.read.format(fmt).options(**options).load(path) if path else spark.read.format(fmt).options(**options).load()
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in equal.items()])) if equal else df


def view_of(df: DataFrame, columns: Sequence[str] | None = None, where: Column | None = None, order: Sequence | None = None) -> DataFrame:
    """SRC-02: chosen columns of the rows that hold, in order."""
    df = df.filter(where) if where is not None else df
    df = df.orderBy(*order) if order else df
    return df.select(*columns) if columns else df


def pages(df: DataFrame):
    """SRC-02 for sink adapters: rows one by one, one partition in memory at a time."""
    return df.toLocalIterator(prefetchPartitions=False)


def read_delimited(spark: SparkSession, path: str, delimiter: str = "comma", header: bool = True) -> DataFrame:
    """SRC-04: text columns; without a header they are Column_1, Column_2, ..."""
    df = spark.read.csv(path, sep=DELIMITERS.get(delimiter, delimiter), header=header, inferSchema=False, multiLine=False)
    return df if header else df.toDF(*[f"Column_{i + 1}" for i in range(len(df.columns))])


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """SRC-05"""
    return spark.read.json(path, multiLine=multi_line)


def key_paths(schema: T.StructType, before: str = "") -> list[str]:
    """SRC-05: dotted paths of all leaves; arrays of objects are entered by their first element."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, f"{before}{f.name}"
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            kind = kind.elementType
        out += key_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return out


def nested(schema: T.StructType, path: str) -> Column:
    """SRC-05: the value at a dotted path, first elements of arrays of objects."""
    c, kind = None, schema
    for name in path.split("."):
        c = F.col(f"`{name}`") if c is None else c.getField(name)
        kind = kind[name].dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            c, kind = F.get(c, F.lit(0)), kind.elementType
    return c


def clean_names(names: Sequence[str]) -> list[str]:
    """SRC-07: letters, digits and underscores, not led by a digit; repeats get _2, _3, ..."""
    out: list[str] = []
    seen: set[str] = set()
    for n in names:
        base = re.sub(r"\W+", "_", n.strip()).strip("_") or "column"
        base = f"c_{base}" if base[0].isdigit() else base
        name, k = base, 2
        while name.lower() in seen:
            name, k = f"{base}_{k}", k + 1
        seen.add(name.lower())
        out.append(name)
    return out


def evidence_table(df: DataFrame, columns: dict[str, tuple[str, str]], source_tool: str, artifact_type: str, source_path: str, key: Sequence[str], event_time: Column | None = None, collected: Column | None = None) -> DataFrame:
    """SRC-07: source columns -> (name, type), with lineage. The id is a hash of the key columns, so reruns agree."""
    names = clean_names([n for n, _ in columns.values()])
    mapped = [F.col(f"`{c}`").try_cast(t).alias(n) for (c, (_, t)), n in zip(columns.items(), names, strict=True)]
    ident = F.xxhash64(F.lit(artifact_type), *[F.col(f"`{k}`") for k in key]).alias("artifact_id")
    none = F.lit(None).cast("timestamp")
    return df.select(ident, F.lit(source_tool).alias("source_tool"), (collected if collected is not None else none).alias("collection_timestamp"), (event_time if event_time is not None else none).alias("primary_timestamp"), F.lit(artifact_type).alias("artifact_type"), F.lit(source_path).alias("source_path"), *mapped)


def build_evidence(tables: dict[str, DataFrame], mappings: Sequence[dict], path: str | None = None) -> dict[str, DataFrame]:
    """SRC-08: all evidence tables of a list of mappings; written by artifact type where a path is given."""
    made = {m["artifact_type"]: evidence_table(tables[m["table"]], m["columns"], m["source_tool"], m["artifact_type"], m["table"], m["key"], m.get("event_time")) for m in mappings if m["table"] in tables}
    if path:
        for kind, df in made.items():
            df.write.mode("append").partitionBy("artifact_type").parquet(f"{path}/{kind}")
    return made


def union_view(tables: dict[str, DataFrame]) -> DataFrame:
    """SRC-10: the union of all columns, null where a table has none, with the table's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("_source_table", F.lit(n)) for n, df in tables.items()])


def value_type(x: Column) -> Column:
    """SRC-11: INTEGER, REAL, DATETIME or TEXT of one value; null for null."""
    t = F.trim(x.cast("string"))
    return F.when(t.rlike(r"^[+-]?\d{1,18}$"), "INTEGER").when(t.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "REAL").when(t.rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}([ T]\d{2}:\d{2}(:\d{2})?.*)?$"), "DATETIME").when(t.isNotNull(), "TEXT")


def column_types(df: DataFrame) -> DataFrame:
    """SRC-11: column, type that fits all its filled rows: one aggregate over all columns."""
    order = ["INTEGER", "REAL", "DATETIME", "TEXT"]
    rank = lambda c: F.array_position(F.array(*[F.lit(o) for o in order]), value_type(F.col(f"`{c}`")))
    one = df.agg(*[F.struct(F.min(rank(c)).alias("lo"), F.max(rank(c)).alias("hi"), F.count(F.col(f"`{c}`")).alias("n")).alias(c) for c in df.columns])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("r")) for c in df.columns])).alias("p")).select("p.column", "p.r.*")
    # whole numbers fit REAL; times don't fit beside numbers
    fits = F.when(F.col("n") == 0, "TEXT").when(F.col("hi") <= 2, F.element_at(F.array(F.lit("INTEGER"), F.lit("REAL")), F.col("hi").cast("int"))).when((F.col("lo") == 3) & (F.col("hi") == 3), "DATETIME").otherwise("TEXT")
    return long.select("column", F.when(F.col("n") == 0, "TEXT").otherwise(fits).alias("type"))


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """SRC-12: typed columns beside the raw text, which stays where the cast fails."""
    sql = {"INTEGER": "bigint", "REAL": "double", "DATETIME": "timestamp", "TEXT": "string"}
    for c, t in types.items():
        df = df.withColumn(f"{c}_raw", F.col(c).cast("string")).withColumn(c, F.col(f"{c}_raw").try_cast(sql[t]))
    return df


def problems(df: DataFrame, types: dict[str, str], required: Sequence[str] = ()) -> Column:
    """SRC-13: array of struct(column, error, value) of a row."""
    sql = {"INTEGER": "bigint", "REAL": "double", "DATETIME": "timestamp", "TEXT": "string"}
    bad = lambda c, e: F.struct(F.lit(c).alias("column"), F.lit(e).alias("error"), F.col(c).cast("string").alias("value"))
    checks = [F.when(F.col(c).isNull(), bad(c, "missing")) for c in required] + [F.when(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(sql[t]).isNull(), bad(c, f"not {t}")) for c, t in types.items()]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validated(df: DataFrame, types: dict[str, str], required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """SRC-13: valid rows, and the others with their errors."""
    d = df.withColumn("errors", problems(df, types, required))
    return d.filter(F.size("errors") == 0).drop("errors"), d.filter(F.size("errors") > 0)


def trimmed(df: DataFrame) -> DataFrame:
    """SRC-14"""
    return df.select(*[F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def table_statistics(df: DataFrame) -> DataFrame:
    """SRC-15: rows, columns, and filled values of each column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), *[F.count(F.col(f"`{c}`")).alias(f"n_{c}") for c in df.columns])


def indicator_pairs(df: DataFrame, value: str, key: str, source: str) -> DataFrame:
    """SRC-16: (value, key, source) of an indicator list; blank pairs don't count."""
    d = df.select(F.trim(F.col(value).cast("string")).alias("value"), F.trim(F.col(key).cast("string")).alias("key"), F.lit(source).alias("source"))
    return d.filter((F.col("value") != "") & (F.col("key") != ""))


def sniffed(spark: SparkSession, path: str, value: str, key: str) -> tuple[str, str]:
    """SRC-16: delimiter and encoding of a delimited list. The delimiter is the one that makes both columns out of the first
    line, else a comma. The encoding is UTF-8 unless some line isn't valid in it; any bytes are valid ISO-8859-1."""
    first = spark.read.text(path).limit(1).first()
    line = (first["value"] if first else "").lstrip("\ufeff")
    fits = [d for d in (",", ";", ":", "\t", "|") if {value, key} <= {c.strip().strip('"') for c in line.split(d)}]
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return fits[0] if fits else ",", "ISO-8859-1" if bad else "UTF-8"


def read_indicators_any(spark: SparkSession, path: str, value: str = "value", key: str = "key", source: str = "list") -> DataFrame:
    """SRC-16: an indicator list whose delimiter and encoding aren't known."""
    delimiter, encoding = sniffed(spark, path, value, key)
    df = spark.read.csv(path, sep=delimiter, header=True, encoding=encoding)
    return indicator_pairs(df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns]), value, key, source)


def read_indicators(spark: SparkSession, path: str, value: str, key: str, source: str, fmt: str = "csv", delimiter: str = "comma", encoding: str = "UTF-8") -> DataFrame:
    df = spark.read.json(path) if fmt == "json" else spark.read.csv(path, sep=DELIMITERS.get(delimiter, delimiter), header=True, encoding=encoding)
    return indicator_pairs(df, value, key, source)


def export(df: DataFrame, path: str, fmt: str = "json", columns: Sequence[str] | None = None, **options) -> None:
    """SNK-01, SNK-02: JSON, CSV or XML files; nested columns become JSON text in CSV."""
    d = df.select(*columns) if columns else df
    if fmt == "csv":
        d = d.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in d.schema.fields])
        options = {"header": True, **options}
    if fmt == "xml":
        options = {"rowTag": "match", "rootTag": "matches", **options}
    d.write.mode("overwrite").format(fmt).options(**options).save(path)
