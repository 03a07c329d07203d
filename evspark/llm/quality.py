"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one and two tokens): the target, from a bounded sample of rows
labelled good, and the raw text, from all documents. A document's log importance weight is the sum over its n-grams
of the log ratio of the two; texts of more than `span` n-grams count by their average over `span`, so that small errors
of the models don't add up with length. The number of buckets follows the sample: at least 32 target n-grams a bucket
on average, 2^16 buckets at most. Gumbel noise, drawn from the id, is added, and the k documents with the largest sums
stay: an exact sample without replacement in proportion to the weights.

k is not a share fixed beforehand: it is the number of documents whose log weight is at least `floor`, so that only
those go which the raw model explains far better than the target's. The k-th value is located by histograms that Spark sums, so nothing is sorted in one place.

`max_target` bounds the labelled sample (the rows with the smallest hash of the id). Null and empty texts have
weight 1. Without labelled rows all weights are 1 and everything stays. Rows whose noisy weights tie with the k-th
(repeated rows) stay with it. Null ids share a draw.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.shared import IdCache, as_texts, forget, fresh, small_batches, uniform52, written

TOKENS = re.compile(r"\w+|[^\w\s]+")
STEP = np.uint64(0x9E3779B1)
PART = 200_000
SPAN = 100
FLOOR = -8.0  # log weight: clean texts lie near 0 and junk far below


class Buckets:
    """Text -> hashed buckets of its one- and two-token n-grams, in parts of bounded length."""

    def __init__(self, buckets: int):
        self.n = np.uint64(buckets)
        self.cache = IdCache(lambda w: crc32(w.encode("utf-8", "surrogatepass")))

    def __call__(self, text: str) -> Iterator[np.ndarray]:
        tokens = TOKENS.findall(text)
        for i in range(0, len(tokens), PART):
            part = tokens[max(0, i - 1) : i + PART]  # with the token before, for the pair across
            h = np.fromiter(map(self.cache.__getitem__, part), np.uint64, len(part))
            yield np.concatenate((h[1 if i else 0 :] % self.n, (h[:-1] * STEP + h[1:]) % self.n)).astype(np.int64)


@dataclass
class Model:
    log_ratio: np.ndarray


def target_sample(labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most `most` distinct ids of labels, those with the smallest hashes."""
    ids = labels.select(F.col(id_col).alias("target_id")).filter("target_id is not null").distinct().withColumn("h", F.xxhash64("target_id"))
    n = ids.count()
    if n > 2 * most:  # thin out first, so that few rows meet in the final limit
        share = 1.5 * most / n
        ids = ids.filter(F.pmod("h", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return ids.orderBy(F.pmod("h", F.lit(1_000_000)), "target_id").limit(most).select("target_id")


def train(docs: DataFrame, good: DataFrame, buckets: int = 1 << 16, max_target: int = 20_000, id_col: str = "doc_id", text_col: str = "text", good_id: str = "doc_id") -> Model:
    """`good` holds the ids of rows labelled good. Raw counts cover all documents; tasks hand on one sum a bucket."""
    sample = written(target_sample(good, max_target, good_id))
    rows = small_batches(docs).select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("row_id") == F.col("target_id"), "left")
    rows = rows.select(F.col("target_id").isNotNull().alias("target"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        of, sums = Buckets(buckets), np.zeros((2, buckets), np.int64)
        for b in batches:
            for target, text in zip(b.column(0).to_pylist(), as_texts(b.column(1)), strict=True):
                for ids in of(text or ""):
                    counts = np.bincount(ids, minlength=buckets) if len(ids) > buckets else None
                    for to in (0, 1) if target else (1,):
                        if counts is not None:
                            sums[to] += counts
                        else:
                            np.add.at(sums[to], ids, 1)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "target", "raw"])

    t = rows.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    sums = np.zeros((2, buckets))
    at = t.column("bucket").to_numpy()
    sums[0][at], sums[1][at] = t.column("target").to_numpy(), t.column("raw").to_numpy()
    if not sums[0].sum():
        return Model(np.zeros(buckets))
    while buckets > 256 and sums[0].sum() < 32 * buckets:  # halves fold onto each other, as hashes do
        buckets //= 2
        sums = sums[:, :buckets] + sums[:, buckets:]
    # the target's estimate leans on the raw model where it has seen little
    raw = (sums[1] + 0.5) / (sums[1].sum() + 0.5 * buckets)
    lean = (0.05 * sums[0].sum() + 1000.0) / buckets
    target = (sums[0] + lean * raw * buckets) / (sums[0].sum() + lean * buckets)
    return Model(np.log(target / raw))


def log_weight(docs: DataFrame, model: Model, text_col: str = "text", span: int = SPAN) -> Column:
    held = small_batches(docs).sparkSession.sparkContext.broadcast(model.log_ratio)
    state: dict = {}

    def weigh(texts: pa.Array) -> pa.Array:
        if "of" not in state:
            forget()
            state["of"], state["table"] = Buckets(len(held.value)), held.value
        of, table = state["of"], state["table"]

        def one(text: str | None) -> float:
            total, n = 0.0, 0
            for ids in of(text or ""):
                total, n = total + float(table[ids].sum()), n + len(ids)
            return total * min(1.0, span / n) if n else 0.0

        return pa.array([one(t) for t in as_texts(texts)], pa.float64())

    return F.arrow_udf(weigh, "double")(F.col(text_col))


def gumbel(id_col: Column, seed: int) -> Column:
    u = (uniform52(id_col, seed) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(values: DataFrame, col: str, k: int, bins: int = 2048) -> float:
    """The exact k-th largest value (k from 1): histograms narrow down its bin until few distinct values are left."""
    lo, hi = values.agg(F.min(col), F.max(col)).first()
    rest = values
    while lo < hi:
        width = (hi - lo) / bins
        number = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        found = sorted(rest.groupBy(number).agg(F.count(F.lit(1)), F.min(col), F.max(col)).collect(), reverse=True)
        for b, n, low, high in found:
            if k <= n:
                break
            k -= n
        if (low, high) == (lo, hi):
            break
        lo, hi = low, high
        rest = values.filter(F.col(col).between(lo, hi))
    return hi if lo == hi else lo


def noisy_cut(docs: DataFrame, model: Model, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", floor: float = FLOOR) -> tuple[DataFrame, float]:
    """doc_id, log_weight and noisy weight of every row (a written table), and the k-th largest noisy weight."""
    scored = docs.select(F.col(id_col).alias("doc_id"), log_weight(docs, model, text_col).alias("log_weight")).withColumn("noisy", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    scored = written(scored)
    k = scored.filter(F.col("log_weight") >= floor).count()
    return scored, kth_largest(scored, "noisy", k) if k else float("inf")


def judge(docs: DataFrame, good: DataFrame, seed: int = 5, floor: float = FLOOR, **more) -> DataFrame:
    """doc_id, log_weight, noisy, kept for every row of docs."""
    scored, cut = noisy_cut(docs, train(docs, good, **more), seed, floor=floor)
    return scored.withColumn("kept", F.col("noisy") >= F.lit(cut))


def keep_good(docs: DataFrame, good: DataFrame, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", floor: float = FLOOR, **more) -> DataFrame:
    """The rows that stay, all columns kept. Texts are scored again instead of being shuffled to their decision."""
    model = train(docs, good, id_col=id_col, text_col=text_col, **more)
    _, cut = noisy_cut(docs, model, seed, id_col, text_col, floor)
    noisy = fresh(docs, "noisy")
    return docs.withColumn(noisy, log_weight(docs, model, text_col) + gumbel(F.col(id_col), seed)).filter(F.col(noisy) >= F.lit(cut)).drop(noisy)
