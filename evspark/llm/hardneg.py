"""Hard-negative mining over rotated one-bit codes.

Each vector is turned by a random rotation (sign flips and Hadamard transforms, the same for all), and the signs of its
turned components are its code b, a unit vector of +-1 / sqrt(D). Beside the code stands its alignment c = <b, o> with
the turned unit vector o. What is left, o - c * b, is turned again and coded in the same way, a few times over
(`LAYERS`), since one code leaves some 0.6 of a vector, six leave 0.05. So o = c1 * b1 + ... + cm * bm + r, where the residual r is square to bm,
and its norm is stored. For an anchor q, with ti = <bi, q>,

    <x, q> = |x| * (c1 * t1 + ... + cm * tm + <r, q>),    |<r, q>| <= |r| * sqrt(|q|^2 - tm^2)

by Cauchy-Schwarz on the part of q that is square to bm. Each t is estimated by popcounts of the code with bit planes of
the rounded anchor; what rounding can add to it is known too. The interval is certain, so nothing is lost: only rows
whose interval allows that they count are scored, in whole numbers.

Rows are packed into blocks, each of one group of labels, and anchors into chunks. The first pass meets each chunk with
the blocks of its own labels and finds the positives: rows of the anchor's label whose upper end reaches the k-th best
lower end are scored. The second meets chunks with all blocks and finds, for each positive, the best rows of other labels
with a score within its window: rows whose interval meets the window and reaches the k-th best lower end of those that
are certainly in it are scored. A large label or copies of one vector are dealt over as many blocks as they fill.

Chunks and blocks meet by parts, runs of blocks of some megabytes: a chunk is copied once for each part it meets and then
read beside all of the part's blocks, so the copies grow with the parts and not with the blocks. They are merged, never
broadcast: all copies would go through the driver.

Rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors count as padded
with 0, zero vectors score 0. Ties go to the smaller id. A row's own id is neither its positive nor its negative; rows that share an
id are candidates each and one anchor together, with the least label and vector. Positives of score 0 have the window 0,
those below 0 have none. Scores are exact while they fit 63 bits. Empty tables give an empty result; columns beside id,
vector and label don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.shared import mix64, small_batches, written
from evspark.llm.topk import dense, quantised

LABEL_GROUPS = 16
LAYERS = 6  # one-bit codes of a vector
PLANES = 8  # bits of a rounded component of an anchor
AT_ONCE = 64  # anchors compared with a block in one step
WORD = 64  # bits of a code are held in words of 64
PART_BYTES = 16 << 20  # of blocks that a chunk meets at once


class Rotation:
    """Three rounds of sign flips and a Hadamard transform, over dimensions filled up to a power of two."""

    def __init__(self, dim: int, seed: int = 13):
        self.dim = max(WORD, 1 << max(0, dim - 1).bit_length())
        draws = mix64(np.arange(3 * self.dim, dtype=np.uint64) + (np.uint64(seed) << np.uint64(32)))
        self.signs = np.where(draws & np.uint64(1), 1.0, -1.0).reshape(3, self.dim)

    def turn(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.dim))
        out[:, : x.shape[1]] = x
        for signs in self.signs:
            out *= signs
            h = 1
            while h < self.dim:
                v = out.reshape(len(x), -1, 2, h)
                out = np.stack((v[:, :, 0] + v[:, :, 1], v[:, :, 0] - v[:, :, 1]), axis=2).reshape(len(x), self.dim)
                h *= 2
            out /= self.dim**0.5
        return out


@dataclass
class Codes:
    """One-bit codes: bits (rows x layers x words), alignment of each, norms of the vectors and of their unit residuals."""

    bits: np.ndarray
    align: np.ndarray
    norm: np.ndarray
    left: np.ndarray


def encoded(x: np.ndarray, rotation: Rotation, layers: int = LAYERS) -> Codes:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    rest = rotation.turn(x) / np.where(norm > 0, norm, 1.0)[:, None]
    bits, align = [], []
    for layer in range(layers):
        rest = rotation.turn(rest) if layer else rest
        up = rest >= 0
        bits.append(np.packbits(up, axis=1).view(np.uint64))
        align.append(np.abs(rest).sum(axis=1) / rotation.dim**0.5)
        rest -= np.where(up, 1.0, -1.0) * (align[-1] / rotation.dim**0.5)[:, None]
    return Codes(np.stack(bits, axis=1), np.stack(align, axis=1), norm, np.sqrt((rest**2).sum(axis=1)))


def intervals(anchors: np.ndarray, codes: Codes, rotation: Rotation, planes: int = PLANES) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the inner products of each anchor (rows) with each coded vector (columns)."""
    q, root = anchors, rotation.dim**0.5
    middle, width = np.zeros((len(anchors), len(codes.norm))), np.zeros((len(anchors), len(codes.norm)))
    for layer in range(codes.bits.shape[1]):
        q = rotation.turn(q)
        low, high = q.min(axis=1, initial=np.inf), q.max(axis=1, initial=-np.inf)
        step = (high - low) / (2**planes - 1)
        step[step <= 0] = 1.0
        units = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
        slack = np.abs(q - (low[:, None] + step[:, None] * units)).sum(axis=1) / root
        rounded = low * rotation.dim + step * units.sum(axis=1)
        bits = [np.packbits((units >> j & 1).astype(bool), axis=1).view(np.uint64) for j in range(planes)]
        dot = np.zeros(middle.shape, np.uint32)
        for w in range(codes.bits.shape[2]):
            word = np.ascontiguousarray(codes.bits[:, layer, w])
            for j in range(planes):
                dot += np.bitwise_count(bits[j][:, w, None] & word[None, :]).astype(np.uint32) << np.uint32(j)
        ones = np.bitwise_count(codes.bits[:, layer]).sum(axis=1, dtype=np.int64)
        t = (2 * (low[:, None] * ones[None, :] + step[:, None] * dot) - rounded[:, None]) / root
        middle += codes.align[None, :, layer] * t
        width += codes.align[None, :, layer] * slack[:, None]
    norm2 = (q * q).sum(axis=1)[:, None]
    width += codes.left[None, :] * np.sqrt(np.maximum(0.0, norm2 - np.maximum(0.0, np.abs(t) - slack[:, None]) ** 2)) + 1e-7 * np.sqrt(norm2)
    return codes.norm * (middle - width) - 1e-6, codes.norm * (middle + width) + 1e-6


def products(anchor: np.ndarray, others: np.ndarray, small: bool) -> np.ndarray:
    """Exact inner products of one anchor with the surviving rows: in doubles while sums stay below 2^53."""
    return np.rint(others.astype(np.float64) @ anchor.astype(np.float64)).astype(np.int64) if small else others @ anchor


def kth_best(values: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """For each row the k-th greatest allowed value, or -inf where fewer are allowed."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(np.where(allowed, values, -np.inf), -k, axis=1)[:, -k]


def first_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores first, ties by the smaller id."""
    if ids.dtype == object:
        ids = np.unique(ids, return_inverse=True)[1]
    if len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


@dataclass
class Block:
    """Unpacked rows: candidates of a block, or anchors of a chunk."""

    ids: np.ndarray
    labels: np.ndarray
    vecs: np.ndarray


def steps(chunk: Block) -> Iterator[slice]:
    return (slice(i, i + AT_ONCE) for i in range(0, len(chunk.ids), AT_ONCE))


def score_rows(chunk: Block, block: Block, may: np.ndarray, first: int, small: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(anchor's place, the candidates' places, their scores) for each anchor, from `first` on, that may have some."""
    for a in np.flatnonzero(may.any(axis=1)).tolist():
        at = np.flatnonzero(may[a])
        yield first + a, at, products(chunk.vecs[first + a], block.vecs[at], small)


def positives_in(chunk: Block, block: Block, codes: Codes, rotation: Rotation, k: int, small: bool) -> tuple[list[tuple[int, int, int]], int]:
    """(anchor's place, candidate's place, score) of the k best rows of each anchor's label, and how many were scored."""
    out, scored = [], 0
    for part in steps(chunk):
        low, high = intervals(chunk.vecs[part], codes, rotation)
        may = (chunk.labels[part, None] == block.labels[None, :]) & (chunk.ids[part, None] != block.ids[None, :])
        may &= high >= kth_best(low, may, k)[:, None]
        for a, at, score in score_rows(chunk, block, may, part.start, small):
            scored += len(at)
            out += [(a, int(at[i]), int(score[i])) for i in first_of(score, block.ids[at], k)]
    return out, scored


def negatives_in(chunk: Block, windows: np.ndarray, block: Block, codes: Codes, rotation: Rotation, k: int, small: bool) -> tuple[list[tuple[int, int, int, int]], int]:
    """(anchor's place, window's number, candidate's place, score) of the k best rows of other labels within each window
    of each anchor (windows: anchors x windows x (least, most score)), and how many were scored."""
    out, scored = [], 0
    for part in steps(chunk):
        low, high = intervals(chunk.vecs[part], codes, rotation)
        other = (chunk.labels[part, None] != block.labels[None, :]) & (chunk.ids[part, None] != block.ids[None, :])
        may = np.zeros(other.shape, bool)
        for w in range(windows.shape[1]):
            least, most = windows[part, w, 0, None].astype(np.float64), windows[part, w, 1, None].astype(np.float64)
            meets = other & (high >= least) & (low <= most) & (least <= most)
            if meets.any():  # windows beyond an anchor's positives are empty
                bar = kth_best(low, meets & (low >= least) & (high <= most), k)
                may |= meets & (high >= bar[:, None])
        for a, at, score in score_rows(chunk, block, may, part.start, small):
            scored += len(at)
            for w, (least, most) in enumerate(windows[a].tolist()):
                fit = np.flatnonzero((score >= least) & (score <= most))
                out += [(a, w, int(at[fit[i]]), int(score[fit[i]])) for i in first_of(score[fit], block.ids[at[fit]], k)]
    return out, scored


def floor_div(a: Column, b: int) -> Column:
    """floor(a / b) of whole numbers."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: Fraction = Fraction(50, 100), high: Fraction = Fraction(95, 100), id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0, block: int = 2048, chunk: int = 512, scored: list | None = None, parts: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (is_anchor is a condition
    on vec_id) and each of its `positives` best rows of the same label the first `negatives` rows of other labels whose
    score is from low to high times the positive's.

    Blocks hold about `block` rows, chunks about `chunk` anchors; blocks form `parts` parts at least (four a core), if there
    are as many, and more where these would be over PART_BYTES. scored, if given, gets (products taken, pairs met) for
    each pass; tasks that ran twice count twice."""
    spark = vectors.sparkSession
    counted = [(spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)) for _ in range(2)]
    named = vectors.select(F.struct(F.col(id_col).alias("id"), F.col(label_col).alias("label")).alias("key"), F.col(vec_col).alias("v"))
    rows = quantised(small_batches(named), "key", "v", scale).select(F.col("vec_id.id").alias("vec_id"), F.col("vec_id.label").alias("label"), "q").filter("vec_id is not null and label is not null")
    rows = written(rows.withColumn("row_no", F.monotonically_increasing_id()))
    ids, labels = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    result = f"anchor_id {ids}, positive_id {ids}, rank int, negative_id {ids}, positive_score long, negative_score long"
    biggest = F.max(F.array_max(F.transform("q", lambda x: F.abs(x))))
    group = F.pmod(F.xxhash64("label"), F.lit(LABEL_GROUPS)).cast("int")
    facts = rows.groupBy(group.alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.sum(is_anchor.cast("long")).alias("anchors"), F.max(F.size("q")).alias("dim"), biggest.alias("biggest")).orderBy("grp").collect()  # at most LABEL_GROUPS
    if not facts or not sum(r["anchors"] or 0 for r in facts):
        return spark.createDataFrame([], result)
    dim, most = max(r["dim"] for r in facts), max(r["biggest"] or 0 for r in facts)
    store, exact = (np.int16 if most < 2**15 else np.int64), float(most) ** 2 * max(1, dim) < 2**53
    rotation = Rotation(dim)
    bins = {r["grp"]: -(-r["n"] // block) for r in facts}
    before, first = 0, {}
    for g in bins:
        first[g], before = before, before + bins[g]
    blocks = before
    row_bytes = dim * np.dtype(store).itemsize + LAYERS * (rotation.dim // 8 + 8) + 100
    together = max(1, min(PART_BYTES // (block * row_bytes), blocks // (parts or 4 * spark.sparkContext.defaultParallelism)))  # blocks of a part
    part_of = lambda c: F.floor(c / together).cast("int")
    of = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("grp"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            x = dense(b.column(2), dim)
            c = encoded(x, rotation)
            raw = [r.tobytes() for r in x.astype(store)]
            bits, align = ([r.tobytes() for r in m] for m in (c.bits, c.align))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *[pa.array(x, pa.binary()) for x in (raw, bits, align)], pa.array(c.norm), pa.array(c.left)], names)

    names = ["vec_id", "label", "row_no", "vec", "bits", "align", "norm", "left"]
    coded = rows.select("vec_id", "label", "q", "row_no").mapInArrow(code, f"vec_id {ids}, label {labels}, row_no long, vec binary, bits binary, align binary, norm double, left double")
    coded = coded.withColumn("grp", group).withColumn("block", (of(first) + F.pmod(F.xxhash64("vec_id", "row_no"), of(bins))).cast("int"))
    packed = coded.groupBy("block").agg(F.collect_list(F.struct("vec_id", "label", "vec", "bits", "align", "norm", "left")).alias("rows"))
    packed = written(packed.withColumn("part", part_of(F.col("block"))))
    chunks = {r["grp"]: -(-r["anchors"] // chunk) for r in facts if r["anchors"]}
    anchors = packed.select(F.explode("rows").alias("r")).select("r.vec_id", "r.label", "r.vec").filter(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("a")).select("vec_id", "a.label", "a.vec").withColumn("grp", group)
    anchors = written(anchors.withColumn("chunk", F.pmod(F.xxhash64("vec_id", F.lit(1)), of(chunks)).cast("int")))

    def unpacked(rows: pa.Array) -> tuple[Block, pa.StructArray]:
        rows = rows.flatten()  # of one list
        vecs = np.frombuffer(b"".join(rows.field("vec").to_pylist()), store).reshape(len(rows), -1).astype(np.int64)
        return Block(values(rows.field("vec_id")), values(rows.field("label")), vecs), rows

    def values(column: pa.Array) -> np.ndarray:
        return np.asarray(column) if pa.types.is_integer(column.type) else np.array(column.to_pylist(), object)

    def pairs(batches: Iterator[pa.RecordBatch]):
        """The chunk, the block and the codes of each joined row."""
        for b in batches:
            for i in range(b.num_rows):
                asked, asked_rows = unpacked(b.column("asked").slice(i, 1))
                cands, rows = unpacked(b.column("rows").slice(i, 1))
                bits = np.frombuffer(b"".join(rows.field("bits").to_pylist()), np.uint64).reshape(len(rows), LAYERS, -1)
                align = np.frombuffer(b"".join(rows.field("align").to_pylist()), np.float64).reshape(len(rows), LAYERS)
                yield asked, asked_rows, cands, rows, Codes(bits, align, np.asarray(rows.field("norm")), np.asarray(rows.field("left")))

    def count(turn: int, n: int, asked: Block, cands: Block) -> None:
        counted[turn][0].add(n)
        counted[turn][1].add(len(asked.ids) * len(cands.ids))

    def find_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, asked_rows, cands, rows, codes in pairs(batches):
            hits, n = positives_in(asked, cands, codes, rotation, positives, exact)
            a, c, s = (pa.array([h[i] for h in hits], pa.int64()) for i in range(3))
            count(0, n, asked, cands)
            yield pa.RecordBatch.from_arrays([asked_rows.field("vec_id").take(a), rows.field("vec_id").take(c), s], ["anchor_id", "positive_id", "positive_score"])

    def find_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asked, asked_rows, cands, rows, codes in pairs(batches):
            given = asked_rows.field("windows")
            windows = np.tile(np.array([1, 0], np.int64), (len(asked_rows), positives, 1))
            sizes = np.asarray(given.value_lengths())
            inner = given.flatten()
            windows[np.arange(positives)[None, :] < sizes[:, None]] = np.stack((np.asarray(inner.field("least")), np.asarray(inner.field("most"))), axis=1)
            hits, n = negatives_in(asked, windows, cands, codes, rotation, negatives, exact)
            starts = np.r_[0, np.cumsum(sizes)]
            a, c, s = (pa.array([h[i] for h in hits], pa.int64()) for i in (0, 2, 3))
            w = pa.array([int(starts[h[0]]) + h[1] for h in hits], pa.int64())
            count(1, n, asked, cands)
            cols = [asked_rows.field("vec_id").take(a), *[inner.field(x).take(w) for x in ("place", "id", "score")], rows.field("vec_id").take(c), s]
            yield pa.RecordBatch.from_arrays(cols, ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    own = anchors.groupBy("grp", "chunk").agg(F.collect_list(F.struct("vec_id", "label", "vec")).alias("asked"))
    own = own.withColumn("low", of(first)).withColumn("high", of(first) + of(bins) - 1).drop("grp", "chunk")
    own = own.withColumn("part", F.explode(F.sequence(part_of(F.col("low")), part_of(F.col("high")))))
    met = own.hint("merge").join(packed, "part").filter(F.col("block").between(F.col("low"), F.col("high"))).select("asked", "rows")
    best = written(met.mapInArrow(find_positives, f"anchor_id {ids}, positive_id {ids}, positive_score long"))
    ranked = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id"))
    # rows that share an id are one positive each; the place tells them apart
    taken = best.withColumn("place", ranked).filter(F.col("place") <= positives)
    score = F.col("positive_score")
    least, top = -floor_div(-score * low.numerator, low.denominator), floor_div(score * high.numerator, high.denominator)
    windows = taken.select("anchor_id", F.struct("place", F.col("positive_id").alias("id"), score.alias("score"), least.alias("least"), top.alias("most")).alias("w"))
    windows = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list("w")).alias("windows"))  # at most `positives` each
    asked = anchors.hint("merge").join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    asked = written(asked.groupBy("grp", "chunk").agg(F.collect_list(F.struct("vec_id", "label", "vec", "windows")).alias("asked")))
    every = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // together)))).select("part", "asked")
    found = written(every.hint("merge").join(packed, "part").select("asked", "rows").mapInArrow(find_negatives, f"anchor_id {ids}, place int, positive_id {ids}, positive_score long, negative_id {ids}, negative_score long"))
    if scored is not None:
        scored += [(done.value, met.value) for done, met in counted]
    order = Window.partitionBy("anchor_id", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return top.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
