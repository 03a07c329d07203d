"""SRC-03, QRY-02: pages of large results. The rows are stored once by ranges of their order, with a table of the ranges'
counts; a page, however deep, reads and sorts only the ranges it lies in."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evspark.storage import fresh_path


@dataclass(frozen=True)
class Pages:
    spark: SparkSession
    path: str
    order: tuple
    schema: StructType
    counts: tuple[tuple[int, int], ...]  # (range, rows), in order

    @staticmethod
    def store(df: DataFrame, order: Sequence[Column | str], path: str | None = None, ranges: int | None = None) -> Pages:
        """Store rows for paging in an order. Without `ranges` Spark sizes them. The order should end in a unique column:
        rows that are equal in it have no place of their own."""
        path = path or fresh_path(df.sparkSession)
        by = [*([ranges] if ranges else []), *order]
        cut = df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id())
        cut.write.partitionBy("__range").parquet(path)
        counts = df.sparkSession.read.schema(cut.schema).parquet(path).groupBy("__range").agg(F.count(F.lit(1)).alias("n")).orderBy("__range").collect()  # one row a range
        return Pages(df.sparkSession, path, tuple(order), cut.schema, tuple((r["__range"], r["n"]) for r in counts))

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def page(self, number: int, size: int, first: int = 1) -> DataFrame:
        """One page; pages count from `first`. A page beyond the end is empty."""
        start, before, wanted, skip = (number - first) * size, 0, [], 0
        for r, n in self.counts:
            if before < start + size and before + n > start:
                skip = skip if wanted else start - before
                wanted.append(r)
            before += n
        rows = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("__range").isin(wanted)).drop("__range")
        return rows.orderBy(*self.order).offset(skip).limit(size)
