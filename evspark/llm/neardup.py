"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

A document's set holds the 64-bit hashes of its distinct word shingles; one permutation cuts the hash range into
bins, each bin's least hash is its value, and an empty bin borrows from a bin that a universal hash names (optimal
densification). Rows of bins make band keys; documents that share a key are candidates.

Documents with equal sets are one class, whose smallest id stands for it. Within a bucket the smallest id is the
centre and every other member is one edge from it, so a bucket of m members gives m - 1 candidate pairs. Links are
confirmed on the full sets. Where the members of a bucket still belong to several components, documents of different
components are compared in blocks, so that no link inside a bucket is lost to the star shape, and only links that
join components leave a block. Before components are sought, a document's links to its centres are contracted to about
one a document; then nodes hook onto their least neighbour, and only roots that are still linked go on.

Texts are lower-cased in A-Z and cut at ASCII white space. Fewer words than a shingle: the whole sequence is the one
shingle. Null texts and texts without words have empty sets and are linked with nothing. Rows with a null id are
returned as they are, linked with nothing; rows that share an id are one node. Repeated rows and copies of any number
are one class. Whole texts count, however long: a long text has more shingles, not more band keys. An empty table gives
an empty result; columns beside id and text don't matter here, and drop_near passes them through, whatever their names.
Two documents of the least similarity
share no bucket with a chance of (1 - similarity^rows)^bands: 7e-9 at 0.85, 3e-6 at 0.8, with 32 bands of 5.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.shared import HOT_ROWS, IdCache, Repeats, as_bytes, as_texts, forget, fresh, hits, join_group_facts, mix64, small, small_batches, written

BANDS, ROWS = 32, 5
TRIES = 64
LEVELS = 64  # levels and jumps are expected to number a few; this only stops a defect from looping


class Shingler:
    """Text -> sorted distinct 64-bit hashes of its word shingles."""

    def __init__(self, words: int):
        self.k = words
        self.cache = IdCache(xxhash.xxh3_64_intdigest)
        self.factor = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.k:
            return mix64(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64))
        w = np.fromiter(map(self.cache.__getitem__, words), np.uint64, len(words))
        n = len(w) - self.k + 1
        h = np.zeros(n, np.uint64)
        for j, f in enumerate(self.factor):
            h += mix64(w[j : j + n] + f) * f
        return np.unique(mix64(h))


class OnePermutation:
    def __init__(self, bands: int = BANDS, rows: int = ROWS):
        self.bands, self.rows, n = bands, rows, bands * rows
        self.n = n
        self.edges = np.array([(i << 64) // n for i in range(n)], np.uint64)
        grid = np.arange(n, dtype=np.uint64)[None, :] * np.uint64(TRIES + 1) + np.arange(1, TRIES + 1, dtype=np.uint64)[:, None]
        self.probe = (mix64(grid) % np.uint64(n)).astype(np.int64)
        self.factor = mix64(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.band_no = mix64(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 32))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Band keys of a sorted, non-empty set."""
        at = np.searchsorted(hashes, self.edges)
        ends = np.append(at[1:], len(hashes))
        full = at < ends
        value = hashes[np.minimum(at, len(hashes) - 1)].copy()
        if not full.all():
            empty = np.flatnonzero(~full)
            for probe in self.probe:
                src = probe[empty]
                hit = full[src]
                value[empty[hit]] = value[src[hit]]
                empty = empty[~hit]
                if not len(empty):
                    break
            if len(empty):
                value[empty] = hashes[0]
        v = value.reshape(self.bands, self.rows)
        return mix64((v * self.factor).sum(axis=1, dtype=np.uint64) ^ self.band_no).view(np.int64)


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if empty), band keys."""
    rows = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingle, permute = Shingler(words), OnePermutation()
        for b in batches:
            n, digest, bands = [], [], []
            for text in as_bytes(b.column(1)):
                h = shingle(text)
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                bands.append(permute(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, bands array<long>")


def shingle_sets(docs: DataFrame, words: int, wanted: Repeats, id_col: str, text_col: str) -> DataFrame:
    """doc_id and its set as bytes of sorted unsigned 64-bit integers, for ids that pass the filter `wanted`."""
    named = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    rows = named.select("doc_id", "text", *[c.alias(f"cell{i}") for i, c in enumerate(wanted.cells("doc_id", wanted.half))])
    held = docs.sparkSession.sparkContext.broadcast(wanted.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shingle = Shingler(words)
        for b in batches:
            b = b.filter(pa.array(hits(held.value, np.asarray(b.column(2)), np.asarray(b.column(3)))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle(t).tobytes() for t in as_bytes(b.column(1))], pa.binary())], ["doc_id", "hashes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, hashes binary")


def similar(a: str, b: str, least: Fraction) -> Column:
    """Whether intersection / union of two sets is at least `least`, exactly."""
    up, down = least.numerator, least.denominator

    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(as_texts(x), as_texts(y), strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(p) else 0
            out.append(both > 0 and down * both >= up * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")(F.col(a), F.col(b))


def fewer_links(stars: DataFrame) -> DataFrame:
    """Links (a, b) from centres a as about one a document, which join the same documents: b keeps its least centre, and
    its further centres, of which there is at most one a band, are linked to that one."""
    of = stars.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("centres"))
    others = F.concat(F.array("b"), F.slice("centres", 2, BANDS))
    return of.select(F.element_at("centres", 1).alias("a"), F.explode(others).alias("b")).distinct()


def _roots(hooked: DataFrame) -> DataFrame:
    """up, top, members: the root above each node that others (members of them) hook onto."""
    ups = hooked.groupBy("up").agg(F.count(F.lit(1)).alias("members"))
    tops = written(ups.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("to")), "up", "left").select("up", F.coalesce("to", "up").alias("top"), "members"))
    n = tops.count()
    for _ in range(LEVELS):
        further = tops.filter("up <> top").select(F.col("up").alias("top"), F.col("top").alias("to"))
        jumped = written(tops.join(small(further, n), "top", "left").select("up", F.coalesce("to", "top").alias("top"), "members", F.col("to").isNotNull().alias("moved")))
        tops = jumped.drop("moved")
        if jumped.filter("moved").isEmpty():
            return tops
    raise RuntimeError("roots did not settle")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node reachable) for links (a, b).

    Each node hooks onto its least neighbour; that makes trees, which are flattened by jumping. What links are left
    become links between the roots of trees, and so on until none is left. Only roots that are still linked go on, so
    each level works on far fewer nodes than the one before.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = edges.select(F.col("b").alias("node"), F.col("a").alias("label")).limit(0)
    for _ in range(LEVELS):
        hooked = written(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("up"), F.count(F.lit(1)).alias("links")))
        nodes = hooked.count()
        if not nodes:
            found = labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
            return written(found)
        tops = _roots(hooked)
        level = written(join_group_facts(hooked.select("node", "up"), tops, "up", "members", nodes).select("node", F.col("top").alias("label")))
        over = small(level.select(F.col("node").alias("label"), F.col("label").alias("to")), nodes)
        labels = written(labels.join(over, "label", "left").select("node", F.coalesce("to", "label").alias("label")).unionByName(level))
        more = edges.join(hooked.filter("links > 1").select(F.col("node").alias("b"), "up"), "b").filter("a <> up").select(F.col("up").alias("a"), F.col("a").alias("b")).distinct()
        for side in ("a", "b"):
            more = more.join(level.select(F.col("node").alias(side), F.col("label").alias("top")), side, "left").withColumn(side, F.coalesce("top", side)).drop("top")
        edges = written(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    raise RuntimeError("labels did not settle")


def _sets_of(ids: DataFrame, docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, hashes of the documents in ids (distinct). Other texts are kept out by a bounded filter before the join."""
    member = Repeats.count(ids, "doc_id", ids.count(), least=1)
    return written(shingle_sets(docs, words, member, id_col, text_col).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. A pair's second set travels to its first; the set of a
    centre with many pairs is copied, so that its pairs are dealt over several tasks."""
    pairs = written(pairs)
    hot = max(HOT_ROWS, pairs.count() // 1000)  # so at most a thousand centres are hot
    copies = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT_ROWS)).cast("int").alias("copies"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= hot).select("a", "copies"))
    salted = pairs.join(F.broadcast(copies), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    firsts = sets.select(F.col("doc_id").alias("a"), F.col("hashes").alias("set_a")).join(F.broadcast(copies), "a", "left")
    firsts = firsts.select("a", "set_a", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt"))
    both = salted.join(sets.select(F.col("doc_id").alias("b"), F.col("hashes").alias("set_b")), "b").join(firsts, ["a", "salt"])
    return written(both.filter(similar("set_a", "set_b", least)).select("a", "b"))


def _joining_links(pdf: pd.DataFrame, least: Fraction) -> pd.DataFrame:
    """Links between documents of one or two blocks that share a band key but belong to different components: as many
    as join the components, no more."""
    up, down = least.numerator, least.denominator
    ids, side = pdf["doc_id"].to_numpy(), pdf["side"].to_numpy()
    bands = np.stack([np.asarray(x, np.int64) for x in pdf["bands"]])
    sets = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
    size = np.array([len(x) for x in sets])
    _, root = np.unique(pdf["label"].to_numpy(), return_inverse=True)
    one_block = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    a, b = [], []
    for x in range(len(ids)):
        others = np.arange(x + 1, len(ids)) if one_block else np.flatnonzero(side == 1) if side[x] == 0 else ()
        if not len(others):
            continue
        others = others[(root[others] != root[x]) & (np.minimum(size[others], size[x]) * down >= np.maximum(size[others], size[x]) * up)]
        others = others[(bands[others] == bands[x]).any(axis=1)] if len(others) else others
        if not len(others):
            continue
        flat = np.concatenate([sets[y] for y in others])
        at = np.minimum(np.searchsorted(sets[x], flat), size[x] - 1)
        both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.r_[0, np.cumsum(size[others])[:-1]])
        for y in others[down * both >= up * (size[x] + size[others] - both)]:
            if root[y] != root[x]:
                root[root == root[y]] = root[x]
                a.append(min(ids[x], ids[y]))
                b.append(max(ids[x], ids[y]))
    return pd.DataFrame({"a": a, "b": b})


def _rest_of_links(placed: DataFrame, reps: DataFrame, sets: DataFrame, least: Fraction, block: int) -> DataFrame:
    """Links that the stars missed, from buckets (band, doc_id, centre, label) which hold several components.

    Documents that such buckets connect form a neighbourhood. Its documents are dealt into blocks, and each pair of
    blocks meets in a task of bounded size, where sets are compared in place; pairs are not made into rows. In a
    neighbourhood of more than BANDS blocks this would copy a document more often than it has buckets, so there each
    bucket is dealt into blocks of its own.
    """
    kind = placed.schema["doc_id"].dataType.simpleString()
    near = components(fewer_links(placed.filter("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))))
    member = written(placed.select("doc_id", "label").distinct().join(near.select(F.col("node").alias("doc_id"), F.col("label").alias("near")), "doc_id"))
    blocks = written(member.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")))
    member = join_group_facts(member, blocks, "near", "n", member.count()).select("doc_id", "label", F.col("near").cast("string").alias("group"), "blocks")
    whole = member.filter(F.col("blocks") <= BANDS).join(reps.select("doc_id", "bands"), "doc_id")
    large = placed.join(member.filter(F.col("blocks") > BANDS).select("doc_id"), "doc_id").select("band", "doc_id", "label")
    if not large.isEmpty():
        large = written(large)
        own = written(large.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("n")))
        by_bucket = join_group_facts(large, own, "band", "n", large.count())
        whole = whole.unionByName(by_bucket.select("doc_id", "label", F.concat(F.lit("band "), F.col("band")).alias("group"), "blocks", F.array("band").alias("bands")))
    full = whole.join(sets, "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc_id", "label", "bands", "hashes")
    return written(dealt.groupBy("group", "i", "j").applyInPandas(lambda pdf: _joining_links(pdf, least), f"a {kind}, b {kind}"))


def near_classes(docs: DataFrame, words: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sig = written(signatures(docs, words, id_col, text_col))
    total = sig.count()
    whole = sig.filter("digest is not null and doc_id is not null")
    classes = written(whole.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    reps = written(whole.join(classes.select(F.col("rep").alias("doc_id"), "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]))
    keyed = reps.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    shared_keys = keyed.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared_keys = written(shared_keys.join(reps.select(F.col("doc_id").alias("centre"), F.col("n_shingles").alias("n_centre")), "centre"))
    buckets = written(join_group_facts(keyed, shared_keys, "band", "members", total * BANDS, "inner").drop("members"))
    sets = _sets_of(written(buckets.select("doc_id").distinct()), docs, words, id_col, text_col)
    sizes_fit = F.least("n_shingles", "n_centre") * F.lit(least.denominator) >= F.greatest("n_shingles", "n_centre") * F.lit(least.numerator)
    star = buckets.filter("doc_id <> centre").filter(sizes_fit).select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    labels = components(fewer_links(_confirmed(star, sets, least)))
    of = labels.select(F.col("node").alias("doc_id"), "label")
    placed = written(buckets.select("band", "doc_id", "centre").join(of, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
    torn = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).filter("lo <> hi")
    placed = written(join_group_facts(placed, written(torn.select("band", "members")), "band", "members", placed.count(), "inner").drop("members"))
    rest = _rest_of_links(placed, reps, sets, least, block)
    for side in ("a", "b"):  # further links join whole components
        rest = rest.join(of.withColumnRenamed("doc_id", side), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    merged = components(rest).select(F.col("node").alias("label"), F.col("label").alias("to"))
    labels = labels.join(small(merged, merged.count()), "label", "left").select(F.col("node").alias("rep"), F.coalesce("to", "label").alias("found"))
    alone = merged.select(F.col("label").alias("rep"), F.col("to").alias("joined"))  # representatives that no star linked
    classes = classes.join(labels, "rep", "left").join(alone, "rep", "left")
    classes = written(classes.select("digest", "copies", F.coalesce("found", "joined", "rep").alias("component_id")))
    found = join_group_facts(whole.select("doc_id", "n_shingles", "digest"), classes, "digest", "copies", total).select("doc_id", "n_shingles", "component_id")
    rest = sig.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near(docs: DataFrame, words: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group, all columns kept. Rows whose id can't be among the dropped ones
    pass straight through a bounded filter; only the others shuffle."""
    dropped = written(near_classes(docs, words, least, id_col, text_col).filter("not kept").select(F.col("doc_id").alias("gone")).distinct())
    maybe = Repeats.count(dropped, "gone", dropped.count(), least=1).test(docs.sparkSession, id_col)
    gone = fresh(docs, "gone")
    suspects = docs.filter(F.col(id_col).isNotNull()).filter(maybe).join(dropped.withColumnRenamed("gone", gone), F.col(id_col) == F.col(gone), "left_anti")
    passed = docs.filter(F.col(id_col).isNull()).unionByName(docs.filter(F.col(id_col).isNotNull()).filter(~maybe))
    return passed.unionByName(suspects)
