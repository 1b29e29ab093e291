"""Registered queries of the core, and their SQL. Each query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillforge.plans import pool, records, rows, summaries, teaching, texts

Query = Callable[[SparkSession, str], DataFrame]
GROUPS = (pool, texts, rows, teaching, summaries, records)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for g in GROUPS:
        out |= g.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for g in GROUPS:
        out |= g.SQL
    return out
