"""What the training-data operators share: written tables, group joins, bounded filters, task-side text access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.storage import written  # noqa: F401  for the operators

#: ASCII white space as the contracts name it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A group with at least this many rows, and at least a thousandth of all rows, is hot: so there are at most a thousand.
HOT_ROWS = 1000
#: A dimension table (one row a source) is broadcast up to so many rows; beyond, Spark shuffles for the join.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Lower the session's Arrow batches to 1,000 rows and 8 MB from here on: rows are whole texts, and each task holds a
    batch in the JVM and in Python. The setting belongs to the session and is read when a plan runs, after this returns,
    so it stays lowered; a lower one is left alone. Sessions that mind hand over `docs` of a session.newSession()."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def small(dim: DataFrame, rows: int) -> DataFrame:
    """Broadcast a dimension whose counted rows are within the bound; else leave the join to a shuffle."""
    return F.broadcast(dim) if rows <= BROADCAST_ROWS else dim


def join_group_facts(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int, how: str = "left") -> DataFrame:
    """Join facts (one row a key, its row count in `size`) to rows, without a hot key's rows meeting in one task.

    Keys with at least max(HOT_ROWS, total / 1000) rows number at most a thousand, so they are broadcast;
    all other keys are joined by a shuffle in which no key is large. Both inputs should be written tables.
    """
    least = max(HOT_ROWS, total // 1000)
    hot, cold = facts.filter(F.col(size) >= least), facts.filter(F.col(size) < least)
    hot_keys = hot.select(key)
    return (
        rows.join(F.broadcast(hot), key, "inner")
        .unionByName(rows.join(F.broadcast(hot_keys), key, "left_anti").join(cold, key, how))
    )


def uniform52(id_col: Column, seed: int) -> Column:
    """A whole number of 52 bits, uniform by row id and seed, that any SQL engine can compute (from md5)."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def count_floor(totals: DataFrame, n: str, most: int, levels: int = 20_000) -> int:
    """The least count from which on at most `most` rows of totals have it; found from a histogram of counts, one bin a
    count up to `levels` and 64 bins to each doubling beyond."""
    bin_ = F.when(F.col(n) <= levels, F.col(n)).otherwise(F.lit(levels + 1) + F.floor(F.log2(F.col(n) / levels) * 64))
    hist = totals.groupBy(bin_.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("low"), F.max(n).alias("high")).orderBy(F.col("bin").desc()).collect()
    least, kept = (hist[0]["high"] if hist else 0) + 1, 0
    for r in hist:
        if kept + r["rows"] > most:
            break
        least, kept = r["low"], kept + r["rows"]
    return least


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in have:
        name += "_"
    return name


SLICE = 256


def as_texts(column: pa.Array) -> Iterator[str | None]:
    """A string column's values, a few hundred at a time, so that a batch isn't held twice."""
    for i in range(0, len(column), SLICE):
        yield from column.slice(i, SLICE).to_pylist()


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """A string column's UTF-8 bytes, null as empty, a few hundred at a time."""
    for i in range(0, len(column), SLICE):
        for x in column.slice(i, SLICE).cast(pa.large_binary()).to_pylist():
            yield x or b""


class IdCache(dict):
    """word -> value, filled on demand by a function, of bounded size: when it holds `limit` words they become the old
    generation, from which words that are met again come back, and the generation before is forgotten."""

    def __init__(self, make, limit: int = 100_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


_KEPT: dict = {}


def kept(key, make):
    """A worker's one long-lived object: kept for later tasks that ask for the same key, dropped when a task asks for
    another, so that a worker holds the caches of one operator at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """For tasks that keep nothing: drop what this worker keeps for another operator, to have its memory."""
    _KEPT.clear()


def each_batch(make_row_batch):
    """Wrap a RecordBatch -> RecordBatch function for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield make_row_batch(b)

    return run


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (public domain splitmix constants)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def hits(bits: np.ndarray, *cells: np.ndarray) -> np.ndarray:
    """Whether all of a key's cells are set in the bitmap."""
    out = np.ones(len(cells[0]), bool)
    for c in cells:
        out &= (bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
    return out


class Repeats:
    """A two-hash Bloom filter of the keys that occur at least `least` times.

    Pass one: each task marks its keys' cells, once or twice, and hands on one sparse bitmap for each block of cells it
    touched; a block's bitmaps are merged in one small task, which keeps the cells that enough keys marked. No key that
    is repeated is missed. Another key passes with a chance that depends on the load only. The filter grows with the
    rows, 16 bits each, up to `max_bits`, which bounds what is sent to the driver and broadcast (128 MB); beyond some
    10^8 rows more of them are tested exactly afterwards and results stay the same. least=1 is membership.
    """

    BLOCK = 20  # bits of a cell's number within its block
    FLUSH = 2_000_000

    def __init__(self, bits: np.ndarray, half: int):
        self.bits, self.half = bits, half

    @staticmethod
    def cells(key: str, half: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(half)), F.lit(half) + F.pmod(F.xxhash64(F.lit(2), F.col(key)), F.lit(half))]

    @classmethod
    def count(cls, keys: DataFrame, key: str, rows: int, max_bits: int = 1 << 30, least: int = 2) -> Repeats:
        half = 1 << 15
        while half < min(max_bits // 2, 8 * rows):
            half *= 2
        shift, twice = cls.BLOCK, np.uint32(1 << 31)
        size = min(1 << shift, 2 * half)

        def marked(cells: list[np.ndarray]) -> pa.RecordBatch:
            cell, n = np.unique(np.concatenate(cells), return_counts=True)
            at = (cell & (size - 1)).astype(np.uint32) | np.where(n > 1, twice, np.uint32(0))
            cut = np.flatnonzero(np.diff(cell >> shift)) + 1
            return pa.RecordBatch.from_arrays([pa.array(cell[np.r_[0, cut]] >> shift), pa.array([x.tobytes() for x in np.split(at, cut)], pa.binary())], ["block", "marks"])

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for b in batches:
                held += [np.asarray(c) for c in b.columns]
                n += 2 * b.num_rows
                if n >= cls.FLUSH:
                    yield marked(held)
                    held, n = [], 0
            if n:
                yield marked(held)

        def merge(pdf: pd.DataFrame) -> pd.DataFrame:
            seen = np.zeros(size, np.uint8)
            for raw in pdf["marks"]:
                x = np.frombuffer(raw, np.uint32)
                at = x & ~twice
                seen[at] = np.minimum(seen[at] + 1 + (x >= twice), 2)
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(seen >= least).tobytes()]})

        cells = keys.select(*[c.alias(f"cell{i}") for i, c in enumerate(cls.cells(key, half))])
        blocks = cells.mapInArrow(mark, "block long, marks binary").groupBy("block").applyInPandas(merge, "block long, bits binary")
        bits = np.zeros(2 * half // 8, np.uint8)
        got = blocks.toArrow()  # at most 2 * half / 8 bytes in all
        for no, raw in zip(got.column("block").to_pylist(), got.column("bits").to_pylist(), strict=True):
            bits[no * size // 8 : (no + 1) * size // 8] = np.frombuffer(raw, np.uint8)
        return cls(bits, half)

    def test(self, spark: SparkSession, key: str) -> Column:
        """True for each row whose key may be repeated."""
        held = spark.sparkContext.broadcast(self.bits)

        @F.pandas_udf("boolean")
        def maybe(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(hits(held.value, a.to_numpy(), b.to_numpy()))

        return maybe(*self.cells(key, self.half))
