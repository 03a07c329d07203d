"""AG-05, AG-20, AG-26: distinct counts as parts that are kept and merged exactly.

Identities get dense numbers once (numbered). A part is a bitmap of the numbers seen, in buckets of 32,768, for each key
and time slice; parts of any slices and sources are united by `or` and counted, so distinct counts over any range come
from the parts alone, as sums do. A bucket's bitmap has 4 KB, however many rows went into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.storage import written


def numbered(df: DataFrame, identity: str, name: str = "identity_no") -> DataFrame:
    """identity, number: the distinct identities, null left out, numbered from 0 without gaps: places within ranges of
    identities, plus the ranges' counts before, of which there is one row a range."""
    distinct = df.select(identity).filter(F.col(identity).isNotNull()).distinct()
    ranges = written(distinct.repartitionByRange(identity).sortWithinPartitions(identity).select(identity, F.spark_partition_id().alias("__range")))
    counts = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__range", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(identity)) - 1
    return ranges.withColumn("__place", place).join(counts, "__range").select(identity, (F.col("__before") + F.col("__place")).cast("long").alias(name))


def parts(df: DataFrame, keys: list[str], number: str = "identity_no", sums: dict[str, Column] | None = None) -> DataFrame:
    """keys, bucket, bits, n (rows) and the sums: the pre-aggregate of one table, to be written. Rows without a number
    count as rows only, in a bucket without bits."""
    value = F.col(number)
    bits = F.expr(f"bitmap_construct_agg(bitmap_bit_position(`{number}`)) FILTER (WHERE `{number}` IS NOT NULL)")
    bucket = F.when(value.isNotNull(), F.bitmap_bucket_number(value)).otherwise(-1).alias("bucket")
    return df.groupBy(*keys, bucket).agg(bits.alias("bits"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in (sums or {}).items()])


def merged(kept: DataFrame, keys: list[str], sums: list[str] | None = None) -> DataFrame:
    """keys, n, n_identities and the sums over kept parts: coarser keys, a range of slices or a union of sources."""
    some = [F.sum(c).alias(c) for c in ["n", *(sums or [])]]
    buckets = kept.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), *some)
    count = F.when(F.col("bucket") >= 0, F.bitmap_count("bits")).otherwise(0)
    return buckets.groupBy(*keys).agg(*some, F.sum(count).alias("n_identities"))
