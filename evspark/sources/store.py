"""SNK-03, SNK-04: results as tables of commits, safe to run again and to read while they are written.

A commit writes its rows to a folder of its own and then, last of all, one line of a log: its name, its version, the
folder and the schema. Readers take the log and then only the folders it names, so a write that failed or hasn't ended
isn't seen, and a reader's snapshot stays as it is. A commit of a name that is there already takes its place: names are
those of a run, or of a stream's checkpoint and batch, so what runs again doesn't double. Batches of a stream and whole
runs share a table; columns that only some commits have are null in the others.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "name string, version long, attempt string, schema string"


class ResultStore:
    """Executions, results and matches, each a table under one path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _data(self, table: str, attempt: str) -> str:
        return f"{self.path}/{table}/attempt={attempt}"

    def commits(self, table: str, as_of: int | None = None) -> list:
        """The commits in force, one a name: the last one up to a version. One line a commit is read."""
        try:
            log = self.spark.read.schema(LOG).json(f"{self.path}/_log/{table}/*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            log = []
        last: dict = {}
        for c in sorted((c for c in log if as_of is None or c["version"] <= as_of), key=lambda c: (c["version"], c["attempt"])):
            last[c["name"]] = c
        return sorted(last.values(), key=lambda c: (c["version"], c["attempt"]))

    def version(self, table: str) -> int:
        """The newest version, 0 before the first commit."""
        return max((c["version"] for c in self.commits(table)), default=0)

    def commit(self, table: str, df: DataFrame, name: str) -> int:
        """Write rows under a name, in place of any rows that were committed under it; returns the new version."""
        attempt = uuid.uuid4().hex
        df.write.parquet(self._data(table, attempt))
        version = self.version(table) + 1
        line = self.spark.createDataFrame([(name, version, attempt, df.schema.json())], LOG)
        line.coalesce(1).write.json(f"{self.path}/_log/{table}/{attempt}")
        return version

    def append(self, table: str, df: DataFrame, name: str | None = None) -> int:
        """Commit the rows of one or more executions (column execution_id). Without a name it is that of the executions,
        so that the same ones run again replace their rows."""
        if name is None:
            ids = df.agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("execution_id").cast("string"))), ","), 256)).first()[0]
            name = f"executions {ids}"
        return self.commit(table, df, name)

    def read(self, table: str, execution_id=None, as_of: int | None = None) -> DataFrame:
        """The rows of all commits in force, of one execution if asked for; of an earlier version if asked for."""
        commits = self.commits(table, as_of)
        if not commits:
            raise ValueError(f"nothing is committed to {table}")
        kinds: dict[str, list[str]] = {}
        for c in commits:
            kinds.setdefault(c["schema"], []).append(self._data(table, c["attempt"]))
        parts = [self.spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(*paths) for s, paths in kinds.items()]
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return df.filter(F.col("execution_id") == execution_id) if execution_id is not None else df

    def append_stream(self, table: str, stream: DataFrame, checkpoint: str, **trigger):
        """SNK-04: matches of a stream, a commit a batch, named by the checkpoint and the batch's number."""

        def put(batch: DataFrame, number: int) -> None:
            self.commit(table, batch, f"{checkpoint} {number}")

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
