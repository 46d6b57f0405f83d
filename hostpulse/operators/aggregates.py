"""Window aggregates, last values, pivots, legends and catalogue listings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATIONS = ("mean", "max", "min", "last")
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}


def window_seconds(window: str) -> int:
    """``5m``, ``1h`` and the like in seconds."""
    return int(window[:-1]) * _UNITS[window[-1]]


def _aggregate(name: str, value: str = "value", clock: str = "clock") -> Column:
    return {
        "mean": F.avg(value),
        "max": F.max(value),
        "min": F.min(value),
        "last": F.max_by(value, clock),
    }[name]


def window_aggregate(
    samples: DataFrame,
    window: str = "5m",
    aggregation: str = "mean",
    measurements: Iterable[str] | None = None,
    since: int | None = None,
    until: int | None = None,
    by: Sequence[str] = ("host", "measurement"),
) -> DataFrame:
    """Tumbling aggregate per series; windows without samples are absent.

    Partial aggregation runs before the shuffle, so a hot series sends one row per window.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
    width = window_seconds(window)
    rows = _between(samples, since, until)
    if measurements is not None:
        rows = rows.where(F.col("measurement").isin(*measurements))
    start = F.expr(f"clock div {width}L * {width}L").alias("window_start")
    return (
        rows.groupBy(*by, start)
        .agg(_aggregate(aggregation).alias("value"))
        .select(
            *by,
            "window_start",
            (F.col("window_start") + width).alias("window_end"),
            "value",
            F.lit(aggregation).alias("aggregation_type"),
            F.lit(window).alias("window_size"),
        )
    )


def _between(samples: DataFrame, since: int | None, until: int | None) -> DataFrame:
    if since is not None:
        samples = samples.where(F.col("clock") >= since)
    if until is not None:
        samples = samples.where(F.col("clock") < until)
    return samples


def panel_width(start: int, stop: int, max_points: int) -> int:
    """Seconds per panel window so that a range gives at most ``max_points`` windows."""
    return max(1, -(-(stop - start) // max_points))


def panel_mean(samples: DataFrame, measurement: str, start: int, stop: int, max_points: int) -> DataFrame:
    """Mean per window whose width follows from the displayed range."""
    width = panel_width(start, stop, max_points)
    one = _between(samples, start, stop).where(F.col("measurement") == measurement)
    offset = F.expr(f"(clock - {start}L) div {width}L * {width}L + {start}L")
    return one.groupBy("host", offset.alias("window_start")).agg(F.avg("value").alias("value"))


def to_wide(samples: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("host", "clock")) -> DataFrame:
    """One row per host and time, one column per metric. The metric list is given, never read from data."""
    return samples.groupBy(*by).pivot("measurement", list(metrics)).agg(F.first("value", ignorenulls=True))


def to_long(wide: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("host", "clock")) -> DataFrame:
    """Wide to long; missing values stay as rows with NULL."""
    return wide.unpivot(list(by), list(metrics), "measurement", "value")


def last_values(
    samples: DataFrame, since: int | None = None, until: int | None = None, by: Sequence[str] = ("host", "measurement")
) -> DataFrame:
    return _between(samples, since, until).groupBy(*by).agg(
        F.max("clock").alias("clock"), F.max_by("value", "clock").alias("value")
    )


def legend(samples: DataFrame, by: Sequence[str] = ("host", "measurement")) -> DataFrame:
    """Last, largest and mean value per series in one pass."""
    return samples.groupBy(*by).agg(
        F.max_by("value", "clock").alias("last"), F.max("value").alias("max"), F.avg("value").alias("mean")
    )


def overview(samples: DataFrame, metrics: Sequence[str], since: int, until: int, window: str = "1m") -> DataFrame:
    """Several metrics side by side per window."""
    means = window_aggregate(samples, window, "mean", metrics, since, until)
    return to_wide(means.withColumnRenamed("window_start", "clock"), metrics)


def first_names(samples: DataFrame, column: str, n: int = 50) -> DataFrame:
    return samples.select(column).distinct().orderBy(column).limit(n)


def distinct_names(samples: DataFrame, column: str) -> DataFrame:
    return samples.select(column).distinct()


def first_rows(samples: DataFrame, n: int = 20, by: Sequence[str] = ("host", "measurement")) -> DataFrame:
    """The first n rows of every series; the rank limit is applied before the shuffle too."""
    order = Window.partitionBy(*by).orderBy("clock")
    return samples.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def datapoints(series: DataFrame, target: str, value: str, clock: str) -> DataFrame:
    """Dashboard points: target, value (NULL becomes 0.0) and epoch milliseconds."""
    return series.select(
        F.col(target).alias("target"),
        F.coalesce(F.col(value), F.lit(0.0)).alias("value"),
        (F.col(clock) * 1000).alias("ts_ms"),
    )


def minute_spine(as_of: int, count: DataFrame, value: str, minutes: int = 60, by: Sequence[str] = ("host",)) -> DataFrame:
    """Dense minutes per key, newest first: the newest slot has the value, earlier ones 0.

    ``count`` has one row per key.
    """
    newest = as_of - as_of % 60
    slots = F.sequence(F.lit(0), F.lit(minutes - 1))
    return count.select(*by, value, F.explode(slots).alias("_i")).select(
        *by,
        ((F.lit(newest) - F.col("_i") * 60).cast("bigint") * 1000).alias("ts_ms"),
        F.when(F.col("_i") == 0, F.coalesce(F.col(value), F.lit(0))).otherwise(F.lit(0)).alias("value"),
    )


def slot_counts(samples: DataFrame, as_of: int, minutes: int, by: Sequence[str] = ("host",)) -> DataFrame:
    """Samples per minute over a dense spine of the last minutes; empty minutes are 0."""
    newest = as_of - as_of % 60
    start = newest - (minutes - 1) * 60
    counted = _between(samples, start, newest + 60).groupBy(*by, F.expr("clock div 60L * 60L").alias("slot")).agg(
        F.count("*").alias("_n")
    )
    slots = F.explode(F.sequence(F.lit(start).cast("bigint"), F.lit(newest).cast("bigint"), F.lit(60).cast("bigint")))
    spine = samples.select(*by).distinct().select(*by, slots.alias("slot"))
    return spine.join(counted, [*by, "slot"], "left").select(*by, "slot", F.coalesce("_n", F.lit(0)).alias("samples"))
