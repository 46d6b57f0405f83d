"""Whole models in the registry: every table of a model under one version, made visible by one commit."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.plans.detection import Detector
from hostpulse.plans.failure_prediction import FailureModel
from hostpulse.plans.forecasting import Forecasters
from hostpulse.sources import commits

_TABLES = {
    "detector": ["scaling", "forest", "lof", "offsets", "baseline"],
    "failure": ["parameters", "metrics_on_test", "importances"],
    "forecasters": ["profiles", "models", "quality", "prepared"],
}


def _save(spark: SparkSession, model: object, kind: str, root: str, version: str, training: int, about: dict[str, list[str]]) -> None:
    """Tables first, into a folder of this save alone; the commit makes them a version, at once and whole."""
    folder = commits.attempt(kind)
    for name in _TABLES[kind]:
        getattr(model, name).write.parquet(f"{root}/{folder}/{name}")
    if (classifier := getattr(model, "classifier", None)) is not None:
        classifier.write().save(f"{root}/{folder}/classifier")
    commits.commit(spark, root, kind, version, folder, training, **about)


def catalogue(spark: SparkSession, root: str, kinds: list[str]) -> DataFrame:
    """model_name, version, training_samples of every committed version of the named kinds."""
    return commits.committed(spark, root, kinds).select("model_name", "version", "training_samples")


def _tables(spark: SparkSession, root: str, folder: str, kind: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/{folder}/{n}") for n in _TABLES[kind]}


def save_detector(spark: SparkSession, model: Detector, root: str, version: str, training: int) -> None:
    _save(spark, model, "detector", root, version, training, {"features": model.features})


def load_detector(spark: SparkSession, root: str, version: str | None = None) -> Detector:
    about = commits.manifest(spark, root, "detector", version)
    return Detector(features=list(about.features), **_tables(spark, root, about.folder, "detector"))


def save_failure_model(spark: SparkSession, model: FailureModel, root: str, version: str, training: int) -> None:
    _save(spark, model, "failure", root, version, training, {"features": model.features, "metrics": model.metrics})


def load_failure_model(spark: SparkSession, root: str, version: str | None = None) -> FailureModel:
    about = commits.manifest(spark, root, "failure", version)
    classifier = PipelineModel.load(f"{root}/{about.folder}/classifier")
    return FailureModel(
        metrics=list(about.metrics), features=list(about.features), classifier=classifier,
        **_tables(spark, root, about.folder, "failure"),
    )


def save_forecasters(spark: SparkSession, model: Forecasters, root: str, version: str, training: int) -> None:
    _save(spark, model, "forecasters", root, version, training, {})


def load_forecasters(
    spark: SparkSession, root: str, version: str | None = None, metrics: list[str] | None = None
) -> Forecasters:
    """Stored forecasters, of the named metrics only where some are named."""
    about = commits.manifest(spark, root, "forecasters", version)
    tables = _tables(spark, root, about.folder, "forecasters")
    if metrics is not None:
        tables = {n: t.where(F.col("measurement").isin(metrics)) for n, t in tables.items()}
    return Forecasters(**tables)
