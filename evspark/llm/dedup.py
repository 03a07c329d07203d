"""Exact dedup: two-pass Bloom filtering.

Pass one marks hashed cells in bitmaps, task by task, and keeps those marked twice (shared.Repeats). Pass two tests each
row: what can't be repeated passes straight through, only possible repeats shuffle and are compared by their SHA-256.

Texts are equal when identical after each run of ASCII white space became one space; null counts as empty.
Of equal texts the row with the smallest doc_id stays; null ids come last, and of rows that share the id too exactly
one stays. Whole texts are hashed, however long. An empty table gives an empty result. Columns beside doc_id and text are passed through untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.shared import SPACE, Repeats, fresh, join_group_facts, written


def text_sha256(text: Column) -> Column:
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary"), 256)


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return written(docs.select(F.col(id_col).alias("doc_id"), text_sha256(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("row_no")))


def _facts(suspects: DataFrame) -> DataFrame:
    """One row for each hash among the suspects: the row that stays and the group's size; partial sums first."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row_no")))
    return suspects.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs, dropped ones too."""
    keys = _keys(docs, id_col, text_col)
    total = keys.count()
    maybe = Repeats.count(keys, "text_sha256", total, max_bits).test(docs.sparkSession, "text_sha256")
    tested = written(keys.withColumn("maybe", maybe))
    suspects = tested.filter("maybe").drop("maybe")
    facts = written(_facts(suspects))
    judged = join_group_facts(suspects, facts, "text_sha256", "group_size", total).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_no") == F.col("first.row_no")).alias("kept"), "text_sha256"
    )
    passed = tested.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return passed.unionByName(judged)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 30) -> DataFrame:
    """The rows of docs without later copies, all columns kept.

    Whole rows shuffle only if they may be repeated. They meet the row that stays under (doc_id, hash), a key that is
    never hot, so that a group of any size spreads out.
    """
    spark = docs.sparkSession
    keys = _keys(docs, id_col, text_col)
    repeats = Repeats.count(keys, "text_sha256", keys.count(), max_bits)
    facts = _facts(keys.filter(repeats.test(spark, "text_sha256")))
    sha, keep_sha, keep_id = fresh(docs, "sha"), fresh(docs, "keep_sha"), fresh(docs, "keep_id")
    keep = facts.select(F.col("text_sha256").alias(keep_sha), F.col("first.doc_id").alias(keep_id))
    hashed = docs.withColumn(sha, text_sha256(F.col(text_col)))
    maybe = repeats.test(spark, sha)
    stays = hashed.filter(maybe).join(keep, (F.col(id_col).eqNullSafe(F.col(keep_id))) & (F.col(sha) == F.col(keep_sha)), "left_semi")
    stays = stays.dropDuplicates([id_col, sha])
    return hashed.filter(~maybe).unionByName(stays).drop(sha)
