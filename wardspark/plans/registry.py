"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where the operator is
SQL-expressible, the equivalent SQL over the driver tables (DuckDB spelling) used as the correctness oracle.

Determinism rules shared by both sides: doubles rounded with ``r6`` / ``R6(x)`` (snap to 9 decimals, then round
to 6 — both engines evaluate this identically), counts cast to BIGINT, every computed column aliased.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c) -> Column:
    """Round to 6 decimals after snapping to 9, so last-bit differences from summation order cannot flip a tie."""
    c = F.col(c) if isinstance(c, str) else c
    snapped = F.round(c * F.lit(1e9)) / F.lit(1e9)
    return F.round(snapped * F.lit(1e6)) / F.lit(1e6)


def R6(x: str) -> str:
    return f"(round((round(({x}) * 1e9) / 1e9) * 1e6) / 1e6)"
