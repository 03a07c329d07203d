"""The unified timeline (TL-01..TL-07): artifact tables to one event a timestamp."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.functions.textfn import parse_num, resolved_name


@dataclass(frozen=True)
class Lane:
    """One artifact table on the timeline: its time columns with their event names, its id, and what to show."""

    artifact: str
    table: str
    id_col: str
    times: tuple[tuple[str, str], ...]
    name_col: str | None = None
    path_col: str | None = None
    json_times: tuple[str, str] | None = None
    name_id: tuple[str, str] | None = None  # column with an id whose name is looked up, and what such ids are called


def lane_events(df: DataFrame, lane: Lane, names: DataFrame | None = None) -> DataFrame:
    """TL-01..TL-04: one event for each filled time column, and one for each element of a JSON list of times.

    names(id, name) gives the display names of a lane that shows ids; an id without a name is shown as `App ID n`.
    """
    if lane.name_id and names is not None:
        c, kind = lane.name_id
        known = names.filter("id is not null").groupBy(F.col("id").alias("__id")).agg(F.min("name").alias("__name"))
        df = df.join(known, F.col(c) == F.col("__id"), "left").withColumn("__shown", F.when(F.col(c).isNotNull(), resolved_name(F.col("__name"), F.col(c), kind)))
        lane = replace(lane, name_col="__shown")
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    each = [F.struct(F.col(c).cast("timestamp").alias("ts"), F.lit(kind).alias("event_kind")) for c, kind in lane.times]
    every = F.array(*each)
    if lane.json_times:
        c, kind = lane.json_times
        listed = F.transform(F.from_json(c, "array<string>"), lambda t: F.struct(F.try_to_timestamp(t).alias("ts"), F.lit(kind).alias("event_kind")))
        every = F.concat(every, F.coalesce(listed, F.expr("array()").cast("array<struct<ts:timestamp,event_kind:string>>")))
    rows = df.select(F.lit(lane.artifact).alias("artifact"), F.lit(lane.table).alias("source_table"), F.col(lane.id_col).cast("long").alias("row_id"), text(lane.name_col).alias("display_name"), text(lane.path_col).alias("full_path"), F.explode(F.filter(every, lambda e: e["ts"].isNotNull())).alias("e"))
    return rows.select("artifact", "source_table", "row_id", "display_name", "full_path", F.col("e.ts").alias("ts"), F.col("e.event_kind").alias("event_kind"))


def timeline(tables: dict[str, DataFrame], lanes: list[Lane], lo=None, hi=None, artifacts: list[str] | None = None, ordered: bool = False, names: DataFrame | None = None) -> DataFrame:
    """TL-05: events of all lanes in a range; a global sort only where it is asked for."""
    parts = [lane_events(tables[lane.table], lane, names) for lane in lanes if lane.table in tables and (artifacts is None or lane.artifact in artifacts)]
    df = reduce(lambda a, b: a.unionByName(b), parts)
    if lo is not None:
        df = df.filter(F.col("ts").between(F.lit(lo).cast("timestamp"), F.lit(hi).cast("timestamp")))
    return df.orderBy("ts", "artifact", "row_id", "event_kind") if ordered else df


def lane_view(events: DataFrame, artifact: str, numbers: list[str] | None = None) -> DataFrame:
    """TL-06: one lane's events, numbers in text turned into numbers."""
    df = events.filter(F.col("artifact") == artifact)
    return df.withColumns({c: parse_num(F.col(c)) for c in numbers or []})


def event_detail(table: DataFrame, id_col: str, row_id) -> DataFrame:
    """TL-07"""
    return table.filter(F.col(id_col) == row_id)
