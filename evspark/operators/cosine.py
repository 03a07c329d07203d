"""SR-08: exact cosine search by partial products.

Vectors are turned to their principal axes, the ones with most weight first. A pair's product is taken a few axes at a
time; what is left of it is at most the product of the two rests' norms (Cauchy-Schwarz). A pair whose best case falls
short of the query's bar - the least similarity asked for, or the k-th best worst case - is given up; only pairs that
stay in are taken to the last axis, and then once more in the order of the components, so that equal vectors tie.

Vectors are packed into blocks and queries into chunks, by hashes; each chunk meets each block under the block's number.
A task keeps k rows a query, and a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evspark.storage import written

STEPS = (8, 16, 32)  # axes after which pairs are given up, and so on by doubling
SLACK = 1e-9  # of rounding


def axes(moment: np.ndarray) -> np.ndarray:
    """Principal axes of a matrix of second moments, as columns, heaviest first."""
    weights, columns = np.linalg.eigh(moment)
    return np.ascontiguousarray(columns[:, np.argsort(-weights)])


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten()
    return np.asarray(flat, np.float64).reshape(len(column), -1)


def cuts(dim: int) -> list[int]:
    out = [s for s in STEPS if s < dim]
    while out and out[-1] * 2 < dim:
        out.append(out[-1] * 2)
    return [*out, dim]


def survivors(q: np.ndarray, x: np.ndarray, other: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, vector) of turned unit vectors that may be among the k best over `least`, and how many products were
    taken in full. `other` says which pairs count."""
    ends = cuts(q.shape[1])
    rest = lambda m, d: np.sqrt(np.maximum(0.0, 1.0 - (m[:, :d] ** 2).sum(axis=1)))
    got = q[:, : ends[0]] @ x[:, : ends[0]].T
    at, to = np.nonzero(other)
    got = got[at, to]
    for d, end in zip(ends, [*ends[1:], None], strict=True):
        room = rest(q, d)[at] * rest(x, d)[to] + SLACK
        bar = np.full(len(q), least)
        if k <= len(x):
            worst = np.full((len(q), len(x)), -np.inf)
            worst[at, to] = got - room
            bar = np.maximum(bar, np.partition(worst, -k, axis=1)[:, -k])
        on = np.flatnonzero(got + room >= bar[at])
        at, to, got = at[on], to[on], got[on]
        if end is not None:
            got = got + np.concatenate([np.einsum("ij,ij->i", q[at[i : i + 65_536], d:end], x[to[i : i + 65_536], d:end]) for i in range(0, len(at), 65_536)] or [np.zeros(0)])
            full = len(at)
    return at, to, full if len(ends) > 1 else int(other.sum())


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed component by component."""
    sums = [np.zeros(len(a)) for _ in range(3)]
    for d in range(a.shape[1]):
        for s, (x, y) in zip(sums, ((a, b), (a, a), (b, b)), strict=True):
            s += x[:, d] * y[:, d]
    return sums[0] / (np.sqrt(sums[1]) * np.sqrt(sums[2]))


def best(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, least: float, block: int = 2048, chunk: int = 256, full: list | None = None) -> DataFrame:
    """query_id, rank, id, similarity: the k most similar vectors with a similarity over `least` (strictly) for each query,
    ties to the smaller id; a query's own id doesn't count.

    Vectors that are null, of no length, or that hold null or non-finite components, and those shorter than the longest,
    take no part. full, if given, gets (products taken in full, pairs); tasks that ran twice count twice."""
    spark = vectors.sparkSession
    counted = (spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0))

    def sound(df: DataFrame, name: str) -> DataFrame:
        v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
        good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0)
        return df.select(F.col(id_col).alias(name), v.alias("v")).filter(F.col(name).isNotNull() & F.coalesce(good, F.lit(False)))

    vecs = sound(vectors, "id")
    n, dim = vecs.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    kind = vecs.schema["id"].dataType.simpleString()
    shape = f"query_id {kind}, id {kind}, similarity double"
    asked = sound(queries, "query_id").filter(F.size("v") == (dim or 0))
    n_asked = asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, similarity double")
    vecs = vecs.filter(F.size("v") == dim)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in filter(len, batches):
            x = matrix(b.column(0))
            x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["axis", "sums"])

    sums = vecs.select("v").mapInArrow(moments, "axis int, sums array<double>").select("axis", F.posexplode("sums").alias("other", "s")).groupBy("axis", "other").agg(F.sum("s").alias("s"))
    moment = np.zeros((dim, dim))
    for r in sums.toLocalIterator():  # dim * dim numbers
        moment[r["axis"], r["other"]] = r["s"]
    turn, blocks, chunks = axes(moment), -(-n // block), -(-n_asked // chunk)
    dealt = lambda c, parts: F.pmod(F.xxhash64(c, F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    packed = vecs.withColumn("block", dealt("id", blocks)).groupBy("block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vs"))
    wanted = asked.withColumn("chunk", dealt("query_id", chunks)).groupBy("chunk").agg(F.collect_list("query_id").alias("q_ids"), F.collect_list("v").alias("qs"))
    wanted = written(wanted).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).drop("chunk")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q_ids, qs, ids, vs = (b.column(c).slice(i, 1).flatten() for c in ("q_ids", "qs", "ids", "vs"))
                q, x = matrix(qs), matrix(vs)
                unit = lambda m: (m / np.sqrt((m * m).sum(axis=1))[:, None]) @ turn
                a, b_ids = np.array(q_ids.to_pylist(), object), np.array(ids.to_pylist(), object)
                at, to, done = survivors(unit(q), unit(x), a[:, None] != b_ids[None, :], k, least)
                counted[0].add(done)
                counted[1].add(len(q) * len(x))
                s = exact(q[at], x[to])
                keep = s > least
                at, to, s = at[keep], to[keep], s[keep]
                order = np.lexsort((np.unique(b_ids, return_inverse=True)[1][to], -s, at))
                at, to, s = at[order], to[order], s[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                top = place < k
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at[top])), ids.take(pa.array(to[top])), pa.array(s[top])], ["query_id", "id", "similarity"])

    # merged, never broadcast: the chunks' copies, one a block, would all go through the driver
    met = wanted.hint("merge").join(packed, "block").select("q_ids", "qs", "ids", "vs")
    hits = written(met.mapInArrow(search, shape))
    if full is not None:
        full.append((counted[0].value, counted[1].value))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "similarity")
