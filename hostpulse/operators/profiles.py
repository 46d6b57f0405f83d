"""Forecasting profile of a metric: family from its name, parameters from family and statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions.labels import metric_family

SERIES = ("host", "measurement")


def _by_family(parameter: str) -> Column:
    known = [(family, p[parameter]) for family, p in fixed.FAMILY_PARAMETERS.items() if parameter in p]
    return reduce(lambda acc, kv: acc.when(F.col("family") == kv[0], F.lit(kv[1])), known, F).otherwise(None)


def _load_parameter(parameter: str, low: Column) -> Column:
    return F.when(low, fixed.LOW_LOAD[parameter]).otherwise(fixed.HIGH_LOAD[parameter])


def profile_columns(name: Column, mean: Column, std: Column, largest: Column) -> list[Column]:
    """Parameters as columns; expects a ``family`` column to exist."""
    load = F.col("family") == "load_average"
    low = (mean < fixed.LOW_LOAD_MEAN) & (largest < fixed.LOW_LOAD_MAX)
    load_cap = F.when(~low, F.greatest(F.lit(fixed.LOAD_CAP_MINIMUM), largest * fixed.LOAD_CAP_FACTOR))
    divisor = reduce(lambda acc, s: acc.when(largest > s[0], s[1]), fixed.LOAD_DIVISORS, F).otherwise(1.0)
    plain = ["data_type", "unit", "business_hours", "seasonality_scale", "interval_width", "floor"]
    return [
        *[_by_family(p).alias(p) for p in plain],
        F.when(load, _load_parameter("growth", low)).otherwise(_by_family("growth")).alias("growth"),
        F.when(load, _load_parameter("changepoint_scale", low))
        .otherwise(_by_family("changepoint_scale"))
        .alias("changepoint_scale"),
        F.when(load, load_cap).otherwise(_by_family("cap")).alias("cap"),
        *[_by_family(p).alias(p) for p in ("outlier_method", "outlier_factor", "smooth", "fill")],
        F.when(load, divisor).otherwise(1.0).alias("scale_factor"),
        _by_family("target_mape").alias("target_mape"),
        F.when(load, mean * fixed.LOAD_MAE_SHARE)
        .otherwise(F.coalesce(_by_family("target_mae"), std))
        .alias("target_mae"),
    ]


def series_statistics(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    return df.where(F.col("value").isNotNull()).groupBy(*by).agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )


def metric_profiles(df: DataFrame, by: Sequence[str] = SERIES, name: str = "measurement") -> DataFrame:
    """Statistics and forecasting profile per series."""
    stats = series_statistics(df, by).withColumn("family", metric_family(F.col(name)))
    return stats.select("*", *profile_columns(F.col(name), F.col("mean"), F.col("std"), F.col("max")))


def without_outliers(df: DataFrame, profiles: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Rows inside the profile's band: around the quartiles, or up to a percentile. NULL rows fall out."""
    from hostpulse.operators.quantiles import exact_quantiles

    method = profiles.select(*by, "outlier_method", "outlier_factor")
    q = exact_quantiles(df, by, "value", [0.25, 0.75, 0.95, 0.98])
    spread = F.col("quantiles")[1] - F.col("quantiles")[0]
    upper_share = F.when(F.col("outlier_factor") == 0.98, F.col("quantiles")[3]).otherwise(F.col("quantiles")[2])
    band = F.col("outlier_method") == "iqr"
    limits = q.join(method, list(by)).select(
        *by,
        F.when(band, F.col("quantiles")[0] - F.col("outlier_factor") * spread).alias("_low"),
        F.when(band, F.col("quantiles")[1] + F.col("outlier_factor") * spread).otherwise(upper_share).alias("_high"),
    )
    return (
        df.join(limits, list(by))
        .where((F.col("value") <= F.col("_high")) & (F.col("_low").isNull() | (F.col("value") >= F.col("_low"))))
        .select(*df.columns)
    )


def prepared_series(
    df: DataFrame, profiles: DataFrame, by: Sequence[str] = SERIES, clock: str = "clock", rescale: bool = True
) -> DataFrame:
    """Outliers out, large loads divided, spikes smoothed where the profile says so.

    No gap is left to fill afterwards: the outlier filter keeps known values only.
    ``rescale=False`` keeps the original unit, so that forecasts need no scaling back.
    """
    from hostpulse.operators.windows import smoothed

    kept = without_outliers(df, profiles, by).join(profiles.select(*by, "smooth", "scale_factor"), list(by))
    value = F.col("value") / F.col("scale_factor") if rescale else F.col("value")
    both = smoothed(kept.withColumn("value", value).withColumn("_plain", value), by=by, clock=clock)
    return both.select(
        *[F.when(F.col("smooth"), F.col("value")).otherwise(F.col("_plain")).alias("value") if c == "value" else F.col(c)
          for c in df.columns]
    )


def regression_frame(
    df: DataFrame, profiles: DataFrame, by: Sequence[str] = SERIES, clock: str = "clock", order: str | None = None
) -> DataFrame:
    """One row per series and time: ds, y, bounds and business-hour flag. The first of equal times stays."""
    from hostpulse.functions.calendar import is_business_hour
    from hostpulse.operators.dedupe import first_per_time

    named = df.select(*by, F.col(clock).alias("ds"), F.col("value").alias("y"), *([order] if order else []))
    once = first_per_time(named, order, [*by, "ds"]).drop(order) if order else named
    bounds = profiles.select(*by, "cap", "floor", "business_hours")
    return once.where(F.col("y").isNotNull()).join(bounds, list(by)).select(
        *by, "ds", "y", "cap", "floor",
        F.when(F.col("business_hours"), is_business_hour(F.col("ds"))).alias("is_business_hour"),
    )
