"""Streaming twins of batch operators (SS-01..SS-06). Inputs are streaming (or batch) DataFrames with a time column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evspark.operators.rule_index import RuleIndex
from evspark.operators.rules import Rule, tag_rows


def event_counts(df: DataFrame, ts: str, kind: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """SS-01"""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, slide), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), kind, "n")


def session_anchors(df: DataFrame, ts: str, identity: str, gap_s: int, late: str = "10 minutes") -> DataFrame:
    """SS-02: islands of each identity; a gap of exactly gap_s stays inside."""
    w = F.session_window(ts, f"{gap_s} seconds 1 microseconds")
    return df.withWatermark(ts, late).groupBy(w.alias("w"), identity).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n")).select(identity, "start_ts", "end_ts", "n")


def without_repeats(df: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """SS-03"""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def interval_match(a: DataFrame, b: DataFrame, a_ts: str, b_ts: str, key: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """SS-04: rows of two streams with equal keys within +-seconds; state is kept as long as the watermark asks for."""
    x, y = a.withWatermark(a_ts, late).alias("a"), b.withWatermark(b_ts, late).alias("b")
    span = F.expr(f"INTERVAL {seconds} SECONDS")
    return x.join(y, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col(f"b.{b_ts}") >= F.col(f"a.{a_ts}") - span) & (F.col(f"b.{b_ts}") <= F.col(f"a.{a_ts}") + span))


def tagged(df: DataFrame, rules: Sequence[Rule] | RuleIndex) -> DataFrame:
    """SS-05: stateless; rules by the thousand as an index."""
    return rules.tag_rows(df) if isinstance(rules, RuleIndex) else tag_rows(df, rules)


WAITING = pa.schema({"key": pa.string(), "ts": pa.int64(), "opens": pa.bool_()})
OPEN = pa.schema({"key": pa.string(), "started": pa.int64(), "last": pa.int64()})


def _packed(rows: Sequence[tuple], schema: pa.Schema) -> bytes:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema).serialize().to_pybytes()


def _rows(packed: bytes, schema: pa.Schema) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in pa.ipc.read_record_batch(pa.py_buffer(packed), schema).columns], strict=True)


class OpenClose(StatefulProcessor):
    """Sessions in event time of the keys of a group. Rows wait until the watermark has passed them, so that they are taken
    in the order of their times, however they came; then only the start of an open session and the last event's time of
    its key stay. A call of the state costs milliseconds, so that waiting rows are kept in packets, and open sessions as one."""

    def __init__(self, ongoing_us: int | None):
        self.ongoing_us = ongoing_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getValueState("held", "open binary, wakes long")

    def _wake(self, at_us: int, wakes: int | None) -> int:
        """A timer for the first waiting row, unless one fires before."""
        if wakes is None or at_us < wakes:
            self.handle.registerTimer(at_us // 1000 + 1)
            return at_us
        return wakes

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        packed, wakes = held if held is not None else (_packed([], OPEN), None)
        first = None
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[us]").astype("int64")
            batch = pa.record_batch([pa.array(pdf["key"], pa.string(), from_pandas=True), pa.array(at.to_numpy()), pa.array(pdf["opens"].to_numpy(bool))], schema=WAITING)
            self.waiting.appendValue((batch.serialize().to_pybytes(),))
            first = min(at) if first is None else min(first, min(at))
        if first is not None:
            self.held.update((bytes(packed), self._wake(int(first), wakes)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.held.get()
        opened = {k: (started, last) for k, started, last in _rows(held[0], OPEN)} if held is not None else {}
        due, rest, out = [], [], []
        for (packet,) in list(self.waiting.get()):
            for row in _rows(packet, WAITING):
                (due if row[1] <= mark else rest).append(row)
        due.sort(key=lambda r: (r[1], not r[2]))  # of equal times the opener comes first
        give_up = lambda t, last: self.ongoing_us is not None and t - last > self.ongoing_us
        for k, t, opens in due:
            started, last = opened.get(k, (None, None))
            if started is not None and give_up(t, last):
                out.append((k, started, None, "ongoing"))
                started = None
            if opens:
                opened[k] = (t if started is None else started, t)
            elif started is not None:
                out.append((k, started, t, "closed"))
                del opened[k]
            else:
                opened.pop(k, None)
        for k in [k for k, (_, last) in opened.items() if give_up(mark, last)]:
            out.append((k, opened.pop(k)[0], None, "ongoing"))
        self.waiting.clear()
        if rest:
            self.waiting.appendValue((_packed(rest, WAITING),))
        wakes = self._wake(min(t for _, t, _ in rest), None) if rest else None
        if opened and self.ongoing_us is not None:
            self.handle.registerTimer((min(last for _, last in opened.values()) + self.ongoing_us) // 1000 + 1)
        if opened or rest:
            self.held.update((_packed([(k, *x) for k, x in opened.items()], OPEN), wakes))
        else:
            self.held.clear()
        if out:
            at = lambda n: pd.to_datetime(pd.Series([r[n] for r in out], dtype="Int64"), unit="us", utc=True)
            yield pd.DataFrame({"key": [r[0] for r in out], "start_ts": at(1), "end_ts": at(2), "end_kind": [r[3] for r in out]})

    def close(self) -> None:
        pass


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def open_close_sessions(df: DataFrame, ts: str, key: str, is_open: Column, is_close: Column, late: str = "10 minutes", ongoing_s: int | None = None, groups: int = 1024) -> DataFrame:
    """SS-06: key, start_ts, end_ts, end_kind of sessions: the first opener starts one, the next closer ends it.

    A session is emitted once the watermark has passed its end, and is the same for every split of the input into
    batches, rows late by up to `late` included. With ongoing_s, a session without an event for longer than that is
    emitted as `ongoing`. State: the rows that the watermark hasn't passed, and one open session a key. Keys share the
    state of one of `groups` by their hash: more for streams of very many keys. Rows that are
    neither openers nor closers count for the watermark. Needs the RocksDB state store, which is set for the session.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), is_open.alias("opens"), is_close.alias("closes")).withWatermark("ts", late)
    # the condition speaks of the time, so that it isn't tried before the watermark is taken
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group")
    rows = rows.filter(F.when(F.col("ts").isNotNull(), F.col("opens") | F.col("closes"))).select(group, "key", "ts", F.coalesce("opens", F.lit(False)).alias("opens"))
    made = OpenClose(None if ongoing_s is None else ongoing_s * 1_000_000)
    return rows.groupBy("group").transformWithStateInPandas(made, "key string, start_ts timestamp, end_ts timestamp, end_kind string", "append", "eventTime")
