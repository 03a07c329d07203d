"""SRC-06, SRC-02: tables of SQLite files as a Spark source and sink.

The path is a file or a folder of files, which driver and executors must share. Each file is read in ranges of its row
ids, a task a range; comparisons with constants are part of the query that a task sends, and only the columns asked for
are read. Tables without row ids, and views, are one range. Columns have the types they declare: whole numbers, real
numbers, bytes, or text for all others; a value of another type is null, except that numbers in a text column are
text. Written folders get one file a task, named when the whole write has ended.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
#: Storage classes that count as a value of a column's type.
CLASSES = {T.LongType: "('integer')", T.DoubleType: "('integer', 'real')", T.BinaryType: "('blob')", T.StringType: "('text', 'integer', 'real')"}


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def files_of(path: str) -> list[str]:
    path = local(path)
    if not os.path.isdir(path):
        return [path]
    return sorted(f"{path}/{f}" for f in os.listdir(path) if f.endswith((".sqlite", ".db")))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(file: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{file.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro", uri=True)


def type_of(declared: str) -> T.DataType:
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


@dataclass
class Span(InputPartition):
    file: str
    first: int | None
    last: int | None

    def __post_init__(self):
        super().__init__((self.file, self.first, self.last))


class Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.files, self.table, self.rows = schema, files_of(options["path"]), options["table"], int(options.get("rows", 1_000_000))
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters):
        kinds = {f.name: type(f.dataType) for f in self.schema.fields}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind, column = kinds.get(name), quoted(name or "")
            # text may be a number in the file, which compares otherwise than its text does
            compared = f"typeof({column}) = 'text' AND {column} COLLATE BINARY" if kind is T.StringType else f"typeof({column}) IN {CLASSES.get(kind)} AND {column}"
            if kind is None or (kind is T.StringType and not isinstance(f, IsNotNull)):
                if kind is T.StringType and type(f) in COMPARE and isinstance(f.value, str):
                    # numbers are let through, and Spark compares their text
                    self.where.append(f"(typeof({column}) <> 'text' OR {column} COLLATE BINARY {COMPARE[type(f)]} ?)")
                    self.values.append(f.value)
                yield f
            elif isinstance(f, IsNotNull):
                self.where.append(f"typeof({column}) IN {CLASSES[kind]}")
            elif type(f) in COMPARE:
                self.where.append(f"({compared} {COMPARE[type(f)]} ?)")
                self.values.append(f.value)
            elif isinstance(f, In):
                self.where.append(f"({compared} IN ({', '.join('?' * len(f.value))}))")
                self.values += list(f.value)
            else:
                yield f

    def partitions(self) -> list[Span]:
        out = []
        for file in self.files:
            with opened(file) as db:
                try:
                    lo, hi = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # no row ids
                    lo = None
            spans = [Span(file, at, min(hi, at + self.rows - 1)) for at in range(lo, hi + 1, self.rows)] if lo is not None else [Span(file, None, None)]
            out += spans
        return out

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        cells = [f"CASE WHEN typeof({quoted(f.name)}) IN {CLASSES[type(f.dataType)]} THEN {'CAST(' + quoted(f.name) + ' AS TEXT)' if isinstance(f.dataType, T.StringType) else quoted(f.name)} END" for f in self.schema.fields]
        where, values = list(self.where), list(self.values)
        if part.first is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [part.first, part.last]
        kinds = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary(), T.StringType: pa.string()}
        schema = pa.schema([(f.name, kinds[type(f.dataType)]) for f in self.schema.fields])
        with opened(part.file) as db:
            found = db.execute(f"SELECT {', '.join(cells)} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            while rows := found.fetchmany(10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class Writer(DataSourceWriter):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.folder, self.table = schema, local(options["path"]), options["table"]

    def write(self, rows) -> Written:
        kinds = {"byte": "INTEGER", "short": "INTEGER", "integer": "INTEGER", "long": "INTEGER", "boolean": "INTEGER", "float": "REAL", "double": "REAL", "binary": "BLOB"}
        named = [(quoted(f.name), kinds.get(f.dataType.typeName(), "TEXT")) for f in self.schema.fields]
        plain = (int, float, str, bytes, bytearray, type(None))
        os.makedirs(self.folder, exist_ok=True)
        file = f"{self.folder}/.{uuid.uuid4().hex}.part"
        with sqlite3.connect(file) as db:
            db.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(' '.join(n) for n in named)})")
            db.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({', '.join('?' * len(named))})", ([v if isinstance(v, plain) else str(v) for v in r] for r in rows))
        db.close()
        return Written(file)

    def commit(self, messages: list) -> None:
        for m in filter(None, messages):
            folder, name = os.path.split(m.file)
            os.rename(m.file, f"{folder}/{name[1:].removesuffix('.part')}.sqlite")

    def abort(self, messages: list) -> None:
        for m in filter(None, messages):
            os.remove(m.file)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        files, table = files_of(self.options["path"]), self.options["table"]
        if not files:
            raise ValueError(f"no SQLite files in {self.options['path']}")
        with opened(files[0]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
        if not found:
            raise ValueError(f"no table {table} in {files[0]}")
        return T.StructType([T.StructField(r[1], type_of(r[2] or "")) for r in found])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, dict(self.options))


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark


def read_database(spark: SparkSession, path: str, table: str, rows: int = 1_000_000) -> DataFrame:
    """A table of one or many SQLite files; `rows` row ids a task."""
    return registered(spark).read.format("sqlite").options(path=path, table=table, rows=str(rows)).load()


def write_database(df: DataFrame, path: str, table: str) -> None:
    """A table as a folder of SQLite files, one a partition. Times and other types are written as text."""
    registered(df.sparkSession)
    df.write.format("sqlite").options(path=path, table=table).mode("append").save()
