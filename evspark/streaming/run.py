"""Running a stream to its end over files: for tests and backfills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evspark.storage import fresh_path

PARTITIONS = "spark.sql.shuffle.partitions"


def read_files(spark: SparkSession, path: str, a_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a path (a file or a folder), oldest first, all or `a_batch` files a batch; plain
    times become instants."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    df = (reader.option("maxFilesPerTrigger", a_batch) if a_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema.fields])


def to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream emits for the input there is now, as a table in the shared folder.

    Each batch has its own folder, so that one that is run again replaces its files; in complete mode only the last
    batch counts. State has two partitions a core at most: a partition is loaded and committed in every batch, whether it
    has rows or not, so that their number is not to grow with the input.
    """
    spark = stream.sparkSession
    base = fresh_path(spark)
    parts = int(spark.conf.get(PARTITIONS))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out" if mode == "complete" else f"{base}/out/batch_no={number}")

    try:  # the stream takes a copy of the session's settings when it starts
        spark.conf.set(PARTITIONS, min(parts, 2 * spark.sparkContext.defaultParallelism))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(put).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PARTITIONS, parts)
    q.awaitTermination()
    df = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/out")
    return df
