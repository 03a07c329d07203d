"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A source's weight gives it a target of words; a document's expected number of copies is its source's target over
its source's size. Where documents have an importance of their own, a document's expectation is in proportion to it
within its source, `cap` at most; what the cap holds back goes to the source's other documents, so that the target stays.
The whole part of the expectation is certain. The fraction p is an inclusion
probability: each document draws U from its id, and documents are ranked by the odds of U over the odds of p. The source
takes them in that order until its words are as near its target as whole documents allow.

No group is sorted in one task: sums of words over bins of the rank locate the one bin in which a source's cut
lies, and only that bin's rows are ranked.

A null text has size 0, a text of any length its full size; null sources are a source of their own, ranked last. Documents of size 0 take no words.
Rows with the same id share a draw, and are taken or left together when they also share the source. An empty table
gives an empty result. Reruns agree, since draws come from ids and the seed, ties in rank go by id, and importances count
in whole 64ths, 64 at most. A null or negative importance counts as 0: such a document is taken in no whole or part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.shared import WORD, fresh, small, uniform52, written

BINS = 4096
UNITS, MOST = 64, 4096  # importances count in whole 64ths, up to 64: so many levels a source has at most


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """source, source_size, target: weights by rank share all words; a target stops at cap times the source's size.

    Sources in order of cap * size / weight are filled up first. The first source whose share of what is left lies
    within its cap fixes the rate for itself and all after it. The windows run over one row a source.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    src = src.withColumn("full", F.col("source_size") * F.lit(float(cap))).withColumn("rate_full", F.col("full") / F.col("weight"))
    by = Window.orderBy("rate_full", F.col("source").asc_nulls_last())
    everyone = Window.partitionBy()
    before = F.coalesce(F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(cap))
    src = src.withColumn("pos", F.row_number().over(by))
    src = src.withColumn("rate", (F.sum("source_size").over(everyone) - before) / F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("first", F.min(F.when(F.col("rate") <= F.col("rate_full"), F.col("pos"))).over(everyone))
    src = src.withColumn("rate_all", F.max(F.when(F.col("pos") == F.col("first"), F.col("rate"))).over(everyone))
    return src.select("source", "source_size", F.when(F.col("pos") < F.col("first"), F.col("full")).otherwise(F.col("rate_all") * F.col("weight")).alias("target"))


def _drawn(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Add whole copies, the inclusion probability, and the rank q with its bin."""
    u = (uniform52(F.col("doc_id"), seed) + F.lit(0.5)) / F.lit(float(1 << 52))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    if "importance" in rows.columns:
        expected = F.when(F.col("importance") > 0, F.least(F.col("cap"), F.coalesce(F.col("per_unit"), F.col("cap")) * F.col("importance"))).otherwise(F.lit(0.0))
    p = F.col("expected") - F.col("whole")
    odds = F.col("u") / (F.lit(1.0) - F.col("u"))
    return (
        rows.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source")), "left")
        .drop("plan_source")
        .withColumn("expected", expected)
        .withColumn("whole", F.floor("expected"))
        .withColumn("u", u)
        .withColumn("q", F.when(p > 0, odds / (p / (F.lit(1.0) - p))))
        .withColumn("bin", F.when(p > 0, F.least(F.floor(F.col("q") / (F.lit(1.0) + F.col("q")) * BINS), F.lit(BINS - 1))))  # orders as q does
    )


def copies_per_unit(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """s0 (source), per_unit: expected copies for one unit of importance, such that a source's expectations, `cap` at most
    each, sum to its target. Levels of importance are filled up from the top; the first whose share of what is left lies
    within the cap fixes the rate for itself and all below it. The windows run over one row a level of a source, MOST at
    most; a source whose documents all reach the cap has no rate."""
    levels = sizes.filter("importance > 0").groupBy("source", "importance").agg(F.sum("size").alias("words"))
    levels = levels.join(targets.select(F.col("source").alias("s0"), "target", "cap"), F.col("source").eqNullSafe(F.col("s0")))
    down = Window.partitionBy("s0").orderBy(F.col("importance").desc())
    before = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = F.sum((F.col("importance") * F.col("words")).cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    rate = F.when(held > 0, (F.col("target") - before * F.col("cap")) / held)
    fits = levels.withColumn("rate", rate).filter(F.col("rate") * F.col("importance") <= F.col("cap"))
    return fits.groupBy("s0").agg(F.max_by("rate", "importance").alias("per_unit"))


def mixing_plan(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """One row a source: its size, target, and the cut (bin, q, id) up to which documents get one copy more."""
    targets = source_targets(sizes, weights, cap).withColumn("cap", F.lit(float(cap)))
    if "importance" in sizes.columns:
        targets = targets.join(copies_per_unit(sizes, targets), F.col("source").eqNullSafe(F.col("s0")), "left").drop("s0")
    targets = written(targets)
    n = targets.count()
    drawn = _drawn(sizes, small(targets, n), seed)
    certain = written(drawn.groupBy(F.col("source").alias("s3")).agg(F.sum(F.col("whole") * F.col("size")).alias("certain")))
    drawn = drawn.filter("q is not null").join(small(certain, n), F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    rest = F.col("target") - F.col("certain")
    bins = drawn.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("certain").alias("certain"))
    up_to = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    # at most BINS rows a source meet here
    cut_bin = (
        bins.withColumn("up_to", up_to)
        .filter((F.col("up_to") > rest) & (F.col("up_to") - F.col("words") <= rest))
        .select("source", F.col("bin").alias("cut_bin"), (F.col("up_to") - F.col("words")).alias("words_before"))
    )
    cut_bin = written(cut_bin)
    n = cut_bin.count()
    inside = drawn.join(small(cut_bin.withColumnRenamed("source", "cut_source"), n), F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("bin") == F.col("cut_bin")))
    order = Window.partitionBy("source").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("words_before") + F.sum("size").over(order) - F.col("size") / F.lit(2.0)
    cut = inside.withColumn("reached", reached).filter(F.col("reached") <= rest).groupBy("source").agg(F.max(F.struct("q", "doc_id")).alias("cut"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    plan = targets.join(cut_bin.select(F.col("source").alias("s1"), "cut_bin"), same("source", "s1"), "left").drop("s1")
    plan = plan.join(cut.select(F.col("source").alias("s2"), F.col("cut.q").alias("cut_q"), F.col("cut.doc_id").alias("cut_id")), same("source", "s2"), "left").drop("s2")
    return written(plan)


def _copies(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    drawn = _drawn(rows, small(plan, plan.count()), seed)
    in_cut = (F.col("q") < F.col("cut_q")) | ((F.col("q") == F.col("cut_q")) & (F.col("doc_id").isNull() | (F.col("doc_id") <= F.col("cut_id"))))
    more = F.col("q").isNotNull() & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(in_cut, F.lit(False))))
    return drawn.withColumn("copies", (F.col("whole") + more.cast("long")).cast("long"))


def _importance(importance: Column | None) -> list[Column]:
    return [] if importance is None else [F.least(F.greatest(F.coalesce(F.round(importance.cast("double") * UNITS).cast("long"), F.lit(0)), F.lit(0)), F.lit(MOST)).alias("importance")]


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (words) for every row of docs."""
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *_importance(importance)))
    plan = mixing_plan(sizes, weights, cap, seed)
    return _copies(sizes, plan, seed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance: Column | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, all columns kept. Texts don't shuffle."""
    sizes = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *_importance(importance)))
    plan = mixing_plan(sizes, weights, cap, seed)
    whole = fresh(docs, "row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *_importance(importance))
    copied = _copies(rows, plan, seed).filter("copies > 0").select(whole, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copied.select(*[F.col(f"{whole}.`{c}`").alias(c) for c in docs.columns])
