"""Registered queries: each runs one operator over the whole derived tables.

A query that plain SQL can express carries that SQL, so that both can be compared.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.sources.tables import ORACLE_VIEWS, Tables

GROUPS = [
    "ingest", "relations", "aggregates", "windows", "cleaning", "features",
    "scalars", "anomalies", "neighbours", "forecasting", "failures", "indicators", "registries", "streams", "models",
]


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


_REGISTERED: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable:
    """Register a query under its function's name. ``covers`` names the inventory rows it stands for."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        if fn.__name__ in _REGISTERED:
            raise ValueError(f"{fn.__name__} is registered twice")
        _REGISTERED[fn.__name__] = Query(fn.__name__, covers, fn, sql)
        return fn

    return add


def registered() -> dict[str, Query]:
    for group in GROUPS:
        importlib.import_module(f"hostpulse.registered.{group}")
    return dict(_REGISTERED)


def runner(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: q.run(Tables(spark, folder))


def oracle(q: Query) -> str | None:
    if q.sql is None:
        return None
    body = q.sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ORACLE_VIEWS.strip()},\n{body[5:]}"
    return f"WITH {ORACLE_VIEWS.strip()}\n{body}"


def rounded(df: DataFrame, *columns: str, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Round result columns for comparison across engines; order of columns is kept.

    Means of short decimals can end exactly half way between two rounded values, where
    engines differ. ``nudge`` (the check SQL adds the same) moves such ties one way.
    """
    def one(c: str) -> Column:
        return F.round(F.col(c) + nudge if nudge else F.col(c), digits).alias(c)

    return df.select(*[one(c) if c in columns else F.col(c) for c in df.columns])


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)
