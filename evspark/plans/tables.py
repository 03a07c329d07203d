"""The driver's tables as evidence: NTZ times become instants on load and go back to plain times on return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in df.schema.fields])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with event_type as the source and user_id as the identity."""
    return load(spark, sf_dir, "events").withColumnRenamed("event_type", "source")


def plain(df: DataFrame) -> DataFrame:
    """Instants as plain times, counts and numbers as they are."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name) for f in df.schema.fields])


def longs(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]
