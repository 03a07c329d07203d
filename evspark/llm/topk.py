"""Exact top-k search by inner product with a pivot-distance index.

Vectors are lifted by one coordinate, sqrt(max norm^2 - norm^2), so that the nearest of them to a query (lifted by 0)
have the largest inner products. Each vector is keyed by its nearest pivot and its distance to it; a pivot's vectors,
sorted by distance, are cut into annuli. By the triangle inequality a vector is no nearer than the gap between the
query's distance to the pivot and its annulus. So a query's search expands over the annuli in the order of their gaps.
A first round looks at the few nearest ones; its k-th best score is the bound, and the second round goes on up to the
first annulus whose gap leaves room for nothing as good: all further ones have wider gaps, and nothing is lost. Where
the bound stops nothing, as for vectors without clusters, the two rounds together are one scan.

Pivots are fitted to a bounded sample (`sample` rows with the smallest hashes); every row is indexed. An annulus is
dealt out over blocks of about `block` rows, so copies of one vector spread; queries are dealt into chunks. A task
meets one block and one chunk.

Vectors that are null, or hold null or non-finite components, take no part. Shorter vectors count as padded with 0.
Components are floor(scale * x). Ties go to the smaller id; a query's own id is no candidate. Rows with a null id take
no part. Rows that share an id are candidates each, and one query together, with the least of their vectors. Scores are
exact while they fit 63 bits. Vectors of any length are read whole. Empty tables give an empty result; columns beside
id and vector don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.shared import written


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """vec_id and its whole-number components; rows that take no part are left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(F.coalesce(sound, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))


def dense(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix of whole numbers, shorter rows padded with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = np.asarray(column.flatten()), np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def choose_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Farthest-first traversal of the sample, from its first row."""
    picked, far = [0], np.full(len(x), np.inf)
    while len(picked) < min(most, len(x)):
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
        nxt = int(far.argmax())
        if far[nxt] <= 0:
            break
        picked.append(nxt)
    return x[picked]


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack((x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))[:, None]))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, d))


def _scores(queries: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while sums stay below 2^53, else in 64-bit integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(others).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return queries.astype(np.float64) @ others.astype(np.float64).T
    return queries @ others.T


def _least(s: np.ndarray):
    return -np.inf if s.dtype.kind == "f" else np.iinfo(np.int64).min


def best(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, pivots: int = 16, rings: int = 8, sample: int = 2048, block: int = 4096, width: int = 4, looked_at: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query. is_query is a condition on vec_id.

    The first round looks at the `width` nearest annuli, the second at all others that the bound allows.
    looked_at, if given, gets one (annuli looked at, annuli there are) over all queries for each round."""
    spark = vectors.sparkSession
    vecs = written(quantised(vectors, id_col, vec_col, scale))
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    dim, most, biggest, n = vecs.agg(F.max(F.size("q")), F.max(norm), F.max(F.array_max(F.transform("q", lambda x: F.abs(x)))), F.count(F.lit(1))).first()
    kind = vecs.schema["vec_id"].dataType.simpleString()
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    store = np.int16 if (biggest or 0) < 2**15 else np.int64
    h = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000))
    some = vecs if n <= 2 * sample else vecs.filter(h < int(1.5 * sample / n * 1_000_000) + 1)
    picked = some.orderBy(h, "vec_id").limit(sample).select("q").toArrow()
    points = choose_pivots(_lift(dense(picked.column("q"), dim), most), pivots)
    ids = f"vec_id {kind}"

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            q = dense(b.column(1), dim)
            d = _distances(_lift(q, most), points)
            near = d.argmin(axis=1)
            raw = [r.tobytes() for r in q.astype(store)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near]), pa.array(raw, pa.binary())], ["vec_id", "pivot", "dist", "vec"])

    keyed = written(vecs.mapInArrow(key, f"{ids}, pivot int, dist double, vec binary"))
    cuts = {r["pivot"]: r["cuts"] for r in keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / rings for i in range(1, rings)], 1000).alias("cuts")).collect()}
    edges = F.array(*[F.array(*[F.lit(float(x)) for x in cuts.get(p, [])]).cast("array<double>") for p in range(len(points))])
    ring = F.size(F.filter(F.element_at(edges, F.col("pivot") + 1), lambda x: x < F.col("dist"))) + F.col("pivot") * rings
    keyed = written(keyed.withColumn("ring", ring))
    annuli = keyed.groupBy("ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("ring").collect()  # at most pivots * rings
    ring_no = np.array([r["ring"] for r in annuli])
    lo, hi = np.array([r["lo"] for r in annuli]), np.array([r["hi"] for r in annuli])
    parts = {r["ring"]: -(-r["n"] // block) for r in annuli}
    part_of = F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("ring"))
    stored = keyed.select("vec_id", "ring", F.pmod(F.xxhash64("vec_id"), part_of).cast("int").alias("part"), "vec")
    asked = keyed.filter(is_query)
    chunks = max(1, -(-asked.count() // 2048))
    asked = asked.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec"))
    asked = written(asked.select("query_id", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), "vec"))

    def unpack(pdf: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(pdf["vec"]), store).reshape(len(pdf), -1).astype(np.int64)

    def expand(start: int, stop: int):
        """One row for each annulus from the start-th to the stop-th nearest that may hold a vector as good as the bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in filter(len, batches):
                q = np.frombuffer(b"".join(b.column(2).to_pylist()), store).reshape(b.num_rows, -1).astype(np.float64)
                least = np.asarray(b.column(3))
                d = _distances(np.hstack((q, np.zeros((len(q), 1)))), points)[:, ring_no // rings]
                gap = np.maximum(0.0, np.maximum(d - hi, lo - d) - 1e-6 * (1.0 + most**0.5))
                order = np.argsort(gap, axis=1, kind="stable")[:, start:stop]
                gap = np.take_along_axis(gap, order, axis=1)
                top = ((q * q).sum(axis=1)[:, None] + most - gap * gap) / 2
                at, to = np.nonzero(top * (1 + 1e-9) + 1e-6 * (1.0 + most) >= least[:, None])
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(ring_no[order[at, to]], pa.int32())], ["query_id", "chunk", "vec", "least", "ring"])

        return run

    def found(_, qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(qs) or not len(cs):
            return none
        q_ids, c_ids = qs["query_id"].to_numpy(), cs["vec_id"].to_numpy()
        s = _scores(unpack(qs), unpack(cs))
        s[q_ids[:, None] == c_ids[None, :]] = _least(s)
        bar = qs["least"].to_numpy()
        if s.shape[1] > k:
            bar = np.maximum(bar, np.partition(s, -k, axis=1)[:, -k])
        at, to = np.nonzero((s >= bar[:, None]) & (s > _least(s)))
        score = s[at, to]
        order = np.lexsort((c_ids[to], -score, at))
        at, to, score = at[order], to[order], score[order]
        start_of = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1] if len(at) else np.zeros(0, int)
        place = np.arange(len(at)) - np.repeat(start_of, np.diff(np.r_[start_of, len(at)]))
        top = place < k
        return pd.DataFrame({"query_id": q_ids[at[top]], "vec_id": c_ids[to[top]], "score": score[top].astype(np.int64)})

    by, order = ["ring", "part", "chunk"], Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    top = spark.createDataFrame([], f"query_id {kind}, vec_id {kind}, score long, rank int")
    n_asked, came = asked.count(), 0
    while came < len(annuli):
        upto = len(annuli) if came else min(len(annuli), width)
        bound = top.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("least"))
        bound = asked.join(bound, "query_id", "left").select("query_id", "chunk", "vec", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        wanted = written(bound.mapInArrow(expand(came, upto), f"query_id {kind}, chunk int, vec binary, least double, ring int"))
        looks = wanted.count()
        if looked_at is not None:
            looked_at.append((looks, n_asked * (upto - came)))
        if not looks:
            break
        spread = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), (part_of - 1).cast("int"))))
        others = stored.join(written(wanted.select("ring", "chunk").distinct()), "ring")
        hits = spread.groupBy(*by).cogroup(others.groupBy(*by)).applyInPandas(found, f"query_id {kind}, vec_id {kind}, score long")
        every = top.select("query_id", "vec_id", "score").unionByName(hits)
        top = written(every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        came = upto
    return top.select("query_id", "rank", "vec_id", "score")
