"""Feature sets over wide metric frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import calendar
from hostpulse.functions import fixed_values as fixed
from hostpulse.functions.numeric import finite, ratio
from hostpulse.operators import chunks, windows


def pair_ratios(columns: Sequence[str]) -> list[Column]:
    """Each column over each later one."""
    return [
        ratio(F.col(a), F.col(b)).alias(f"{a}_{b}_ratio")
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]


def calendar_set(wide: DataFrame, clock: str = "clock") -> DataFrame:
    return wide.select("*", *calendar.calendar_features(F.col(clock)), *calendar.cyclic_features(F.col(clock)))


def simple_set(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("host",), clock: str = "clock") -> DataFrame:
    """Filled metrics with hour, weekday and weekend flag: the detectors' input."""
    from hostpulse.operators.cleaning import filled, null_if_not_finite

    full = filled(null_if_not_finite(wide, columns), columns, by, clock)
    return full.select("*", *calendar.simple_features(F.col(clock)))


def rolling_lag_set(
    wide: DataFrame,
    columns: Sequence[str],
    minutes: Sequence[int] = fixed.ROLLING_MINUTES,
    periods: Sequence[int] = fixed.LAG_PERIODS,
    by: Sequence[str] = ("host",),
    clock: str = "clock",
) -> DataFrame:
    """Rolling statistics in time, calendar, changes, lags and ratios; rows with any gap dropped.

    Changes and lags share one partitioning and ordering; the windows in time have a shorter one of their own.
    """
    w = chunks.chunk_window(by, clock)
    made = chunks.without_halo(chunks.halo(wide, by, clock, before=max(periods)).select(
        "*",
        *[x for c in columns for x in windows.change_columns(w, c, "rate_change")],
        *[x for c in columns for x in windows.lag_columns(w, c, periods)],
    ))
    rolled = windows.rolling_by_time(made, columns, minutes, by, clock)
    ordered = [*wide.columns, *rolled.columns[len(made.columns):], *made.columns[len(wide.columns):]]
    full = rolled.select(*ordered).select(
        "*", *calendar.calendar_features(F.col(clock), hour_name="hour_of_day"), *pair_ratios(columns)
    )
    doubles = [c for c, t in full.dtypes if t == "double"]
    return full.select(*[finite(F.col(c)).alias(c) if c in doubles else F.col(c) for c in full.columns]).dropna()


def series_parameters(
    wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("host",), clock: str = "clock"
) -> DataFrame:
    """Per key: mean, std and whether it varies, for every column."""
    return wide.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_samp(c).alias(f"{c}__std") for c in columns],
        *[F.coalesce(F.min(c) != F.max(c), F.lit(False)).alias(f"{c}__varies") for c in columns],
    )


def statistical_set(
    wide: DataFrame,
    columns: Sequence[str],
    params: DataFrame | None = None,
    by: Sequence[str] = ("host",),
    clock: str = "clock",
) -> DataFrame:
    """Eighteen features per metric: row-rolling statistics, filled lags, changes and z-score.

    They are NULL where the metric does not vary on that host. ``params`` are fitted
    parameters (``series_parameters``); without them the frame's own are used.
    """
    params = series_parameters(wide, columns, by, clock) if params is None else params
    first = wide.groupBy(*by).agg(*[F.min_by(c, clock).alias(f"{c}__first") for c in columns])
    w = chunks.chunk_window(by, clock)
    reach = chunks.halo(wide, by, clock, before=max(fixed.ROLLING_ROWS) - 1)
    known = reach.join(first.join(params, list(by)), list(by))

    def per_metric(c: str) -> list[Column]:
        made = [
            *windows.row_rolling_columns(w, c, fixed.ROLLING_ROWS),
            *windows.filled_lag_columns(w, c, fixed.FILLED_LAG_PERIODS, F.col(f"{c}__first")),
            *windows.change_columns(w, c, "pct_change", fill=0.0),
            windows.zscore(c, F.col(f"{c}__mean"), F.col(f"{c}__std")).alias(f"{c}_zscore"),
        ]
        return made

    made = known.select("*", *[x for c in columns for x in per_metric(c)])
    own = chunks.without_halo(made)
    kept = list(wide.columns)
    return own.select(
        *kept,
        *[
            F.when(F.col(f"{c}__varies"), F.col(n)).alias(n)
            for c in columns
            for n in statistical_names(c)
        ],
    )


def statistical_names(c: str) -> list[str]:
    return [
        *[f"{c}_rolling_{s}_{n}" for n in fixed.ROLLING_ROWS for s in ("mean", "std", "max", "min")],
        *[f"{c}_lag_{n}" for n in fixed.FILLED_LAG_PERIODS],
        f"{c}_pct_change",
        f"{c}_diff",
        f"{c}_zscore",
    ]


def _row_mean(columns: Sequence[str]) -> Column:
    known = F.array_compact(F.array(*[F.col(c) for c in columns]))
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(known))


def _members(columns: Sequence[str], family: str) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in fixed.FEATURE_FAMILIES[family])]


def domain_set(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Family means over the given metrics, pressure flags and a health score.

    Pass derived names along with the metrics to count them in the families too.
    """
    cpu, memory = _members(metrics, "cpu"), _members(metrics, "memory")
    disk, network = _members(metrics, "disk"), _members(metrics, "network")
    made: list[Column] = []
    health: list[Column] = []
    if cpu:
        mean = _row_mean(cpu)
        grade = reduce(lambda acc, s: acc.when(mean > s[0], s[1]), fixed.CPU_SEVERITY_LIMITS, F).otherwise(0)
        largest = F.greatest(*[F.col(c) for c in cpu]) if len(cpu) > 1 else F.col(cpu[0])
        made += [mean.alias("cpu_avg"), largest.alias("cpu_max"), grade.alias("cpu_utilization_severity")]
        health.append((100 - mean) / 100)
    if memory:
        mean = _row_mean(memory)
        made += [
            mean.alias("memory_avg"),
            F.when(mean > fixed.MEMORY_PRESSURE_LIMIT, 1).otherwise(0).alias("memory_pressure"),
        ]
        health.append((100 - mean) / 100)
    if disk:
        mean = _row_mean(disk)
        made += [mean.alias("disk_avg"), F.when(mean > fixed.DISK_CRITICAL_LIMIT, 1).otherwise(0).alias("disk_critical")]
        health.append((100 - mean) / 100)
    if network:
        made.append(_row_mean(network).alias("network_avg"))
    score = sum(health[1:], health[0]) / len(health) if health else F.lit(1.0)
    return df.select("*", *made, score.alias("system_health_score"))


def domain_names(metrics: Sequence[str]) -> list[str]:
    names: list[str] = []
    if _members(metrics, "cpu"):
        names += ["cpu_avg", "cpu_max", "cpu_utilization_severity"]
    if _members(metrics, "memory"):
        names += ["memory_avg", "memory_pressure"]
    if _members(metrics, "disk"):
        names += ["disk_avg", "disk_critical"]
    if _members(metrics, "network"):
        names.append("network_avg")
    return [*names, "system_health_score"]
