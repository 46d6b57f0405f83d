"""Model registry: versioned tables of metadata and parameters."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions.labels import version_age_hours, version_epoch


def save_version(table: DataFrame, root: str, name: str, version: str) -> str:
    """Write one version of a model table, in place of that version if it is there. Others stay beside it as backups."""
    path = f"{root.rstrip('/')}/{name}"
    table.withColumn("version", F.lit(version)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("version").parquet(path)
    return path


def version_order(version: Column) -> Column:
    """What versions are ordered by: the time at their end, then the text. Versions without a time come first."""
    return F.struct(F.coalesce(version_epoch(version), F.lit(-1)).alias("time"), version.alias("version"))


def load_version(
    spark: SparkSession, root: str, name: str, version: str | None = None, metrics: Iterable[str] | None = None
) -> DataFrame:
    """One version of a model table, the latest when none is named, for the named metrics only.

    The version is a folder, so only its files are read.
    """
    table = spark.read.option("basePath", f"{root}/{name}").parquet(f"{root.rstrip('/')}/{name}")
    if version is None:
        version = table.select("version").distinct().agg(F.max(version_order(F.col("version")))).first()[0].version
    out = table.where(F.col("version") == version)
    return out if metrics is None else out.where(F.col("metric").isin(*metrics))


def latest_versions(registry: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    return registry.groupBy(*by).agg(
        F.max(version_order(F.col("version")))["version"].alias("version"),
        F.max_by("training_samples", version_order(F.col("version"))).alias("training_samples"),
    )


def registry_status(registry: DataFrame, as_of: int) -> DataFrame:
    """Latest version per model with its age, readiness and staleness."""
    age = version_age_hours(F.col("version"), as_of)
    return latest_versions(registry).select(
        "model_name",
        "version",
        "training_samples",
        F.round(age, 1).alias("hours_since_training"),
        F.col("version").isNotNull().alias("ready_for_detection"),
        F.coalesce(age > fixed.FORECAST_STALE_HOURS, F.lit(True)).alias("needs_retraining"),
        F.coalesce(age < fixed.DETECTOR_FRESH_HOURS, F.lit(False)).alias("retrain_skipped"),
    )


def refresh_status(registry: DataFrame, as_of: int) -> DataFrame:
    """Over all models: how many, the oldest age, and whether any needs retraining."""
    age = version_age_hours(F.col("version"), as_of)
    return latest_versions(registry).agg(
        F.count("*").alias("current_models"),
        F.round(F.max(age), 1).alias("oldest_model_hours"),
        (F.max(age) > fixed.FORECAST_STALE_HOURS).alias("needs_retraining"),
    )


def models_to_refresh(
    registry: DataFrame, as_of: int, wanted: Sequence[str] = tuple(fixed.REFRESH_METRICS)
) -> DataFrame:
    """Wanted metrics whose model is missing, unreadable or older than the limit, with the reason."""
    spark = registry.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in wanted])).alias("model_name"))
    age = version_age_hours(F.col("version"), as_of)
    reason = (
        F.when(F.col("version").isNull(), "missing")
        .when(version_epoch(F.col("version")).isNull(), "unreadable")
        .when(age > fixed.FORECAST_STALE_HOURS, "stale")
    )
    joined = names.join(latest_versions(registry), "model_name", "left")
    return joined.select("model_name", "version", reason.alias("reason")).where(F.col("reason").isNotNull())
