"""Scans of the metric store and of relational tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed

READERS = {"parquet", "orc", "json", "csv", "avro", "jdbc"}


def read_relation(
    spark: SparkSession,
    path: str | None = None,
    fmt: str = "parquet",
    schema: str | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Read a table from files or over JDBC. Filters and columns applied to the result are pushed down.

    For JDBC pass ``url``, ``dbtable``, ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` in ``options`` so that the read is split.
    """
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}")
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def scan_history(
    samples: DataFrame,
    as_of: int,
    hours: int = 24,
    hosts: Iterable[str] | None = None,
    measurements: Iterable[str] | None = None,
) -> DataFrame:
    """Samples of the last hours for the named hosts (all when None) and metrics.

    When the store is partitioned by date, the filter on ``date`` prunes whole folders.
    """
    start = as_of - hours * 3600
    out = samples.where((F.col("clock") >= start) & (F.col("clock") < as_of))
    if "date" in samples.columns:
        first = F.to_date(F.timestamp_seconds(F.lit(start)))
        last = F.to_date(F.timestamp_seconds(F.lit(as_of)))
        out = out.where(F.col("date").between(first, last))
    out = out.where(F.col("measurement").isin(*(measurements or fixed.KEY_METRICS)))
    if hosts is not None:
        out = out.where(F.col("host").isin(*hosts))
    return out


def scan_since(relation: DataFrame, clock: str, start: int, **equal: object) -> DataFrame:
    """Relational scan with bound predicates: rows since a time whose columns equal the given values."""
    out = relation.where(F.col(clock) >= start)
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out


def tidy_points(points: DataFrame) -> DataFrame:
    """Store output to a metric frame: drop store columns, rename the time, cast values leniently."""
    store_columns = [c for c in ("result", "table", "_start", "_stop") if c in points.columns]
    out = points.drop(*store_columns).withColumnsRenamed({"_time": "clock", "_measurement": "measurement", "_value": "value"})
    return out.withColumn("value", F.expr("try_cast(value AS DOUBLE)"))


def tidy_relation(relation: DataFrame) -> DataFrame:
    """Epoch columns become timestamps; severity-like columns become numbers where they parse."""
    times = {c: F.timestamp_seconds(F.col(c)) for c in ("alert_time", "event_time") if c in relation.columns}
    numbers = {
        c: F.expr(f"try_cast({c} AS DOUBLE)")
        for c in ("severity", "priority", "trigger_frequency")
        if c in relation.columns
    }
    return relation.withColumns({**times, **numbers})


def union_frames(frames: Iterable[DataFrame]) -> DataFrame:
    """Union of frames whose columns differ; missing columns are NULL."""
    out: DataFrame | None = None
    for frame in frames:
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to union")
    return out
