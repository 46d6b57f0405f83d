"""Train and forecast every series at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.operators import additive, aggregates, arima, evaluation, profiles, quality, windows
from hostpulse.session import materialised

SERIES = ["host", "measurement"]
ROWS = ["host", "metric", "model", "step", "ds", "yhat", "yhat_lower", "yhat_upper"]


def _model_rows(forecast: DataFrame, model: str) -> DataFrame:
    return forecast.withColumnRenamed("measurement", "metric").withColumn("model", F.lit(model)).select(*ROWS)


@dataclass(frozen=True)
class Forecasters:
    profiles: DataFrame
    models: DataFrame
    quality: DataFrame
    prepared: DataFrame


def train(hourly: DataFrame, generation: str = "profiled") -> Forecasters:
    """Profile, prepare and fit all series. Small results are written once for the later passes."""
    minimum, _ = fixed.MIN_FORECAST_ROWS[generation]
    profile = materialised(profiles.metric_profiles(hourly), "profiles")
    prepared = materialised(profiles.prepared_series(hourly, profile, rescale=False), "prepared")
    frame = profiles.regression_frame(prepared, profile)
    models = materialised(additive.fit(frame, profile, minimum), "additive-models")
    return Forecasters(profile, models, quality.series_quality(prepared), prepared)


def forecast(
    fitted: Forecasters, periods: int = 24, generation: str = "profiled", horizons: DataFrame | None = None
) -> DataFrame:
    """Rows of both models for every series, in the long forecast form.

    ``horizons`` (host, measurement, hours) gives series a horizon of their own.
    """
    _, minimum = fixed.MIN_FORECAST_ROWS[generation]
    typed = fitted.prepared.join(fitted.profiles.select(*SERIES, "data_type"), SERIES)
    models, ahead = fitted.models, periods
    if horizons is not None:
        own = horizons.select(*SERIES, F.col("hours").cast("int").alias("_hours"))
        ahead = "_ahead"
        models, typed = (
            x.join(own, SERIES, "left").withColumn(ahead, F.coalesce("_hours", F.lit(periods))).drop("_hours")
            for x in (models, typed)
        )
    return _model_rows(additive.forecast(models, ahead), "additive").unionByName(
        _model_rows(arima.forecast(typed, ahead, minimum), "arima")
    )


def evaluated(hourly: DataFrame, as_of: int, horizon: int = 24, metrics: list[str] | None = None) -> DataFrame:
    """Per series and model: errors on the last fifth after training on the rest, quality and version.

    Each series is forecast as many hours as its own test part, the horizon at least; a series
    without enough rows keeps a row that says so.
    """
    if metrics is not None:
        hourly = hourly.where(F.col("measurement").isin(*metrics))
    split = materialised(windows.split_by_time(hourly), "split")
    training, test = split.where(F.col("part") == "train").drop("part"), split.where(F.col("part") == "test").drop("part")
    fitted = train(training)
    last = training.groupBy(*SERIES).agg(F.max("clock").alias("_last"))
    hours = test.join(last, SERIES).groupBy(*SERIES).agg(
        F.greatest(F.lit(horizon), F.max((F.col("clock") - F.col("_last")) / 3600).cast("int")).alias("hours")
    )
    ahead = forecast(fitted, horizon, horizons=hours)
    actual = test.select("host", F.col("measurement").alias("metric"), F.col("clock").alias("ds"), F.col("value").alias("y"))
    errors = evaluation.forecast_errors(ahead.join(actual, ["host", "metric", "ds"]), evaluation.MODEL_KEY)
    counts = training.groupBy("host", F.col("measurement").alias("metric")).agg(F.count("*").alias("training_samples"))
    scores = fitted.quality.select("host", F.col("measurement").alias("metric"), "quality_score")
    each = counts.join(scores, ["host", "metric"], "left").select(
        "*", F.explode(F.array(F.lit("additive"), F.lit("arima"))).alias("model")
    )
    version = F.concat(F.lit("1.0_"), F.date_format(F.timestamp_seconds(F.lit(as_of)), "yyyyMMdd_HHmmss"))
    return each.join(errors, ["host", "metric", "model"], "left").select(
        "host", "metric", "model", "training_samples", "quality_score", "mae", "rmse", "mape",
        version.alias("version"), F.lit(f"{horizon}h").alias("prediction_horizon"),
        F.when(F.col("mae").isNull(), "insufficient_data").otherwise("success").alias("status"),
    )


def forecast_report(fitted: Forecasters, periods: int = 24) -> DataFrame:
    """Confidence, trend and alerts per series and model."""
    rows = materialised(forecast(fitted, periods), "forecast")
    return evaluation.forecast_summary(rows, evaluation.forecast_alerts(rows))


def series_for_dashboard(rows: DataFrame) -> DataFrame:
    """Datapoints of the preferred model per series."""
    best = evaluation.preferred_model(rows)
    named = best.withColumn("target", F.concat_ws(" ", "host", "metric", F.concat(F.lit("("), "model", F.lit(")"))))
    return aggregates.datapoints(named, "target", "yhat", "ds")
