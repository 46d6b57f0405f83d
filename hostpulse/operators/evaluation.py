"""Forecast errors, confidence, alerts, coverage and model preference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions.labels import metric_family
from hostpulse.operators.windows import paired_by_position, trend

MODEL_KEY = ("host", "metric", "model")


def forecast_errors(pairs: DataFrame, by: Sequence[str], actual: str = "y", predicted: str = "yhat") -> DataFrame:
    """MAE, RMSE and MAPE per series."""
    miss = F.col(actual) - F.col(predicted)
    return pairs.groupBy(*by).agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (F.avg(F.abs(miss / (F.col(actual) + fixed.RATIO_FLOOR))) * 100).alias("mape"),
    )


def forecast_accuracy(actual: DataFrame, forecast: DataFrame, by: Sequence[str], clock: str, forecast_clock: str) -> DataFrame:
    """Errors of forecasts paired with actuals by place, for series of equal length."""
    return forecast_errors(paired_by_position(actual, forecast, by, clock, forecast_clock), by)


def forecast_confidence(forecast: DataFrame, by: Sequence[str] = MODEL_KEY) -> DataFrame:
    """One minus the mean interval width relative to the mean forecast, not below 0."""
    width = F.avg(F.col("yhat_upper") - F.col("yhat_lower"))
    return forecast.groupBy(*by).agg(
        F.greatest(F.lit(0.0), F.lit(1.0) - width / (F.avg("yhat") + 1e-6)).alias("confidence_score")
    )


def forecast_alerts(forecast: DataFrame, step: str = "step") -> DataFrame:
    """Forecast values that would breach their family's limits; ``step`` counts hours ahead from 1."""
    v, family = F.col("yhat"), metric_family(F.col("metric"))
    percentage = family.isin("cpu_percentage", "memory_percentage")
    low = percentage & (v < 5) & (F.col("metric") != "swap_size_pfree")
    load = family == "load_average"
    kind = (
        F.when(percentage & (v > 90), "high_utilization").when(low, "unusually_low").when(load & (v > 4), "high_load")
    )
    grade = (
        F.when(F.col("type") == "unusually_low", "info")
        .when(F.col("type") == "high_utilization", F.when(v < 95, "warning").otherwise("critical"))
        .otherwise(F.when(v < 8, "warning").otherwise("critical"))
    )
    return (
        forecast.withColumn("type", kind)
        .where(F.col("type").isNotNull())
        .select(*MODEL_KEY, F.col(step).alias("hour"), "type", v.alias("value"), grade.alias("severity"))
    )


def forecast_summary(forecast: DataFrame, alerts: DataFrame | None = None, by: Sequence[str] = MODEL_KEY) -> DataFrame:
    """Confidence and direction per model, with its alerts as an array bounded by the horizon."""
    out = forecast_confidence(forecast, by).join(trend(forecast, by, "yhat", "ds"), list(by))
    if alerts is None:
        return out
    grouped = alerts.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("hour", "type", "value", "severity"))).alias("anomaly_alerts")
    )
    return out.join(grouped, list(by), "left")


def fleet_summary(confidence: DataFrame, attempted: DataFrame) -> DataFrame:
    """Over all series: attempted, with at least one forecast, and mean confidence."""
    done = confidence.select("host", "metric").distinct().withColumn("_done", F.lit(1))
    counts = attempted.select("host", "metric").distinct().join(done, ["host", "metric"], "left").agg(
        F.count("*").alias("total_metrics"), F.count("_done").alias("successful_forecasts")
    )
    mean = confidence.agg(F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("average_confidence"))
    one = F.lit(1).alias("_one")
    return counts.select("*", one).join(mean.select("*", one), "_one").drop("_one")


def coverage(qualities: DataFrame, key_metrics: Sequence[str], by: Sequence[str] = ("host",)) -> DataFrame:
    """Trained series per key, their share of the key metrics, and mean quality."""
    return qualities.groupBy(*by).agg(
        F.count("*").alias("total_models"),
        (F.count("*") / len(key_metrics)).alias("model_coverage"),
        F.avg("quality_score").alias("average_data_quality"),
    )


def preferred_model(forecast: DataFrame, order: Sequence[str] = ("additive", "arima")) -> DataFrame:
    """Forecast rows of the best available model per series. The choice is one small row per series."""
    rank = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    best = forecast.select("host", "metric", "model").distinct().where(rank > 0).groupBy("host", "metric").agg(
        F.min_by("model", rank).alias("model")
    )
    return forecast.join(best, ["host", "metric", "model"], "left_semi")
