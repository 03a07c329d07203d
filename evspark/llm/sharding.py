"""Sharding by proportional stratified interleaving: law `rows`, counts at most one apart.

Rows of a source, in the order of a seeded hash of their ids, get the fractional rank (rank - 0.5) / n. Sorted by
that rank all sources interleave in proportion, and equal cuts of the sorted whole give shards that each match the
mixture. Ranks are exact and global, yet no task sorts more than one bin: a rank is the count of rows in lower bins
plus the place within the bin. Bins grow in number with the rows. The draw comes from the id and the text's checksum, so
rows that share an id (null ids) spread out unless they are copies.

Null texts have no bytes; texts of any length count whole; null sources are a source of their own; rows with equal ids,
checksums and sources are alike, and which of them stands first doesn't matter. An empty table gives an empty result;
columns beside id, text and source don't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.shared import uniform52, written

ROWS_A_BIN = 50_000


def bin_bits(rows: int) -> int:
    """4,096 bins, more where those would hold over ROWS_A_BIN rows each, about a million at most."""
    return min(20, max(12, (rows // ROWS_A_BIN).bit_length()))


def shard(docs: DataFrame, shards: int = 24, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (UTF-8 bytes + 8), text_crc32, law, shard, slot (place within the shard)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
            uniform52(F.concat_ws(":", F.col(id_col).cast("string"), F.crc32(text).cast("string")), seed).alias("u"),
        )
    )
    bits = bin_bits(rows.count())
    rows = rows.withColumn("bin", F.shiftright("u", 52 - bits))
    per_bin = rows.groupBy("source", "bin").count()
    by_source = Window.partitionBy("source")  # at most 2^bits rows a source
    bins = per_bin.select(
        F.col("source").alias("bin_source"), F.col("bin").alias("bin_no"), F.sum("count").over(by_source).alias("n"),
        (F.sum("count").over(by_source.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"),
    )
    in_bin = Window.partitionBy("source", "bin").orderBy("u", "doc_id", "size", "text_crc32")
    ranked = rows.join(bins, F.col("source").eqNullSafe(F.col("bin_source")) & (F.col("bin") == F.col("bin_no")))
    ranked = ranked.withColumn("frac", (F.col("before") + F.row_number().over(in_bin) - F.lit(0.5)) / F.col("n"))
    ranked = written(ranked.select("doc_id", "source", "size", "text_crc32", "u", "frac", F.floor(F.col("frac") * (1 << bits)).alias("slice")))
    per_slice = ranked.groupBy("slice").count()
    lower = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # at most 2^bits + 1 rows
    slices = per_slice.select(F.col("slice").alias("slice_no"), (F.sum("count").over(lower) - F.col("count")).alias("lower"), F.sum("count").over(Window.partitionBy()).alias("total"))
    in_slice = Window.partitionBy("slice").orderBy("frac", F.col("source").asc_nulls_last(), "u", "doc_id", "size", "text_crc32")
    placed = ranked.join(F.broadcast(slices), F.col("slice") == F.col("slice_no")).withColumn("pos", F.col("lower") + F.row_number().over(in_slice) - 1)
    number = F.floor(((F.col("pos") + 1) * shards - 1) / F.col("total")).cast("long")
    start = F.floor(F.col("shard_no") * F.col("total") / shards).cast("long")
    return placed.withColumn("shard_no", number).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard_no").cast("int").alias("shard"), (F.col("pos") - start).alias("slot")
    )
