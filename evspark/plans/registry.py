"""Registered queries: each binds one operator to the driver's tables, beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function under a name, with its SQL where there is one."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def _load() -> None:
    """Importing a module of queries registers them."""
    from evspark.plans import q_aggs, q_correlate, q_more, q_reports, q_runs, q_stream, q_text  # noqa: F401


_load()
