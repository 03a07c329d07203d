"""Tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where it is unset a local session, as in tests, takes
    /tmp/checkpoints; a cluster has no such folder, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "/tmp/checkpoints"
    return path.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/evspark-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Cut lineage: write to the shared folder, read back. Survives lost executors, since the files are shared."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
