"""RL-09: an inverted index of character trigrams that narrows rows down to those for which a rule can hold.

Posting lists are a table (field, gram, n, keys): a row holds the keys of one gram in a block of some thousand rows. Blocks are
sorted by gram where they are made, so that a scan for a few grams skips the rest and nothing is shuffled. A text that contains a value has all its trigrams, so a condition's
candidates are the keys that have its rarest few. Nothing is lost: a condition that the index can't narrow (short
values, patterns, comparisons, fields that aren't indexed) counts as met, and a rule asks for as many of its other
conditions as its logic then still needs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.operators.rules import Condition, Rule
from evspark.storage import fresh_path

GRAM = 3
LOOKUP = "rule int, part int, choice int, need int, n int, field string, gram string"


def grams_of(value: str) -> list[str]:
    return sorted({value[i : i + GRAM] for i in range(len(value) - GRAM + 1)})


BITS = 21  # of a code point
BLOCK = 1_000_000  # entries of a block: grams times keys


def text_grams(text: str) -> np.ndarray:
    """Distinct trigrams of a lower-cased text as numbers of three code points."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(p[:-2] << 2 * BITS | p[1:-1] << BITS | p[2:]) if len(p) >= GRAM else np.empty(0, np.int64)


def gram_texts(grams: np.ndarray) -> pa.Array:
    points = np.stack([grams >> 2 * BITS, grams >> BITS & (1 << BITS) - 1, grams & (1 << BITS) - 1], axis=1).astype(np.uint32).tobytes()
    text = points.decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + GRAM] for i in range(0, len(text), GRAM)], pa.string())


class Block:
    """Rows of one task until they are a block of postings."""

    def __init__(self, fields: Sequence[str]):
        self.fields, self.keys, self.entries, self.n = fields, [], [[] for _ in fields], 0
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.keys.append(batch.column(0))
        for held, column in zip(self.entries, batch.columns[1:], strict=True):
            for at, text in enumerate(column.to_pylist(), self.rows):
                if text is not None and len(grams := text_grams(text.decode("utf-8", "replace"))):
                    held.append((at, grams))
                    self.n += len(grams)
        self.rows += batch.num_rows

    def postings(self) -> Iterator[pa.RecordBatch]:
        keys = pa.concat_arrays(self.keys)
        for field, held in zip(self.fields, self.entries, strict=True):
            if not held:
                continue
            grams = np.concatenate([g for _, g in held])
            rows = np.repeat(np.array([at for at, _ in held]), [len(g) for _, g in held])
            order = np.argsort(grams, kind="stable")
            grams, rows = grams[order], rows[order]
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
            ends = np.r_[first, len(grams)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), keys.take(pa.array(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([field] * len(first), pa.string()), gram_texts(grams[first]), pa.array(np.diff(ends)), lists], ["field", "gram", "n", "keys"])


def literals(c: Condition) -> list[str] | None:
    """Values of which a text must contain one for the condition to hold; None where no such list is known."""
    if c.operator in ("contains", "equals", "=", "=="):
        found = [str(c.value)]
    elif c.operator == "in":
        found = [str(v).strip() for v in (c.value if isinstance(c.value, (list, tuple)) else str(c.value).split(","))]
    elif c.operator == "regex" and re.fullmatch(r"(?:[\w /-]|\\\.)+(?:\|(?:[\w /-]|\\\.)+)*", str(c.value), re.ASCII):
        found = [v.replace("\\.", ".") for v in str(c.value).split("|")]  # words joined by |, with no other signs
    else:
        return None
    found = [v.lower() for v in found]
    return found if all(len(v) >= GRAM for v in found) else None


@dataclass(frozen=True)
class GramIndex:
    spark: SparkSession
    path: str
    key: str
    fields: tuple[str, ...]

    @staticmethod
    def build(df: DataFrame, key: str, fields: Sequence[str], path: str | None = None) -> GramIndex:
        """Index some columns of a table. The key tells rows apart; of repeated keys all rows stay or go together."""
        spark, path = df.sparkSession, path or fresh_path(df.sparkSession)
        names = tuple(f.lower() for f in fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(names)
            for b in batches:
                block.add(b)
                if block.n >= BLOCK:
                    yield from block.postings()
                    block = Block(names)
            if block.n:
                yield from block.postings()

        # lower-cased by Spark, as the rules' operators do
        texts = [F.lower(F.col(f).cast("string")).cast("binary").alias(f"t{i}") for i, f in enumerate(fields)]
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *texts)
        made = rows.mapInArrow(run, f"field string, gram string, n long, keys array<{df.schema[key].dataType.simpleString()}>")
        batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(batch)
        spark.conf.set(batch, "1000")  # whole texts
        try:
            made.write.parquet(f"{path}/postings")
        finally:
            spark.conf.set(batch, before)
        return GramIndex(spark, path, key, names)

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def grams(self) -> DataFrame:
        """How many keys have each gram."""
        return self.postings().groupBy("field", "gram").agg(F.sum("n").alias("n"))

    def _counts(self, wanted: set[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Keys that have each wanted gram: at most one row a gram of the rules."""
        asked = F.broadcast(self.spark.createDataFrame(sorted(wanted), "field string, gram string"))
        rows = self._only(sorted({g for _, g in wanted})).join(asked, ["field", "gram"])
        return {(r["field"], r["gram"]): r["n"] for r in rows.groupBy("field", "gram").agg(F.sum("n").alias("n")).collect()}

    def _only(self, grams: Sequence[str]) -> DataFrame:
        """Postings narrowed in the scan where the grams are few."""
        return self.postings().filter(F.col("gram").isin(grams)) if len(grams) <= 1000 else self.postings()

    def lookup(self, rules: Sequence[Rule], rarest: int = 4) -> list[tuple] | None:
        """What to look up: for each rule, condition and literal its rarest grams. None if some rule can't be narrowed."""
        narrow, needs = {}, {}
        for r, rule in enumerate(rules):
            every = rule.logic.upper() == "AND"
            known = {p: v for p, c in enumerate(rule.conditions) if c.field.lower() in self.fields and (v := literals(c)) is not None}
            # conditions that can't be narrowed count as met; OR needs as many as the rule asks for
            need = max(rule.min_indicators, len(rule.conditions) if every else 1) - (len(rule.conditions) - len(known))
            if need <= 0:
                return None
            narrow |= {(r, p): (rule.conditions[p].field.lower(), v) for p, v in known.items()}
            needs[r] = need
        counts = self._counts({(f, g) for f, values in narrow.values() for v in values for g in grams_of(v)}) if narrow else {}
        out = []
        for (r, p), (field, values) in narrow.items():
            for choice, v in enumerate(values):
                grams = sorted((counts.get((field, g), 0), g) for g in grams_of(v))[:rarest]
                if grams[0][0]:  # a gram that no text has: this value occurs nowhere
                    out += [(r, p, choice, needs[r], len(grams), field, g) for _, g in grams]
        return out

    def candidates(self, rules: Sequence[Rule], rarest: int = 4) -> DataFrame | None:
        """Keys of rows for which one of the rules can hold; None: any row can."""
        found = self.lookup(rules, rarest)
        if found is None:
            return None
        asked = F.broadcast(self.spark.createDataFrame(found, LOOKUP))  # the size of the rules
        rows = self._only(sorted({f[-1] for f in found})).drop("n").join(asked, ["field", "gram"]).withColumn("key", F.explode("keys"))
        hits = rows.groupBy("key", "rule", "part", "choice", "need", "n").agg(F.count(F.lit(1)).alias("has"))
        # has > n: a key of several rows
        met = hits.filter("has >= n").groupBy("key", "rule", "need").agg(F.count_distinct("part").alias("parts"))
        return met.filter("parts >= need").select("key").distinct()

    def prefilter(self, df: DataFrame, rules: Sequence[Rule], fall_back: bool = False) -> DataFrame:
        """The rows of df for which one of the rules can hold, rows without a key included. With fall_back all rows stay
        where no row of the index is a candidate, for rules that look at more than the index knows."""
        keys = self.candidates(rules)
        if keys is None or (fall_back and keys.isEmpty()):
            return df
        kept = df.join(keys.withColumnRenamed("key", "__candidate"), F.col(self.key) == F.col("__candidate"), "left_semi")
        return kept.unionByName(df.filter(F.col(self.key).isNull()))
