"""Train and run failure prediction over a fleet."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import ensemble, failures, intervals, neighbours
from hostpulse.plans import datasets
from hostpulse.session import materialised


@dataclass(frozen=True)
class FailureModel:
    metrics: list[str]
    features: list[str]
    parameters: DataFrame
    classifier: PipelineModel
    metrics_on_test: DataFrame
    importances: DataFrame


def train(wide: DataFrame, metrics: Sequence[str], alerts: DataFrame, balance: str = "oversample") -> FailureModel:
    """Label the hours before alerts, make features, balance, fit, and judge on a held-out fifth."""
    labels = intervals.label_failures(wide.select("host", "clock"), alerts)
    parameters, made = datasets.fit_features(wide, metrics)
    names = datasets.pipeline_features(metrics)
    labelled = materialised(made.join(labels, ["host", "clock"]), "failure-training")
    if balance == "oversample":
        ready = materialised(neighbours.oversampled(labelled, names, "failure"), "balanced")
        weight = None
    else:
        ready, weight = failures.class_weights(labelled, "failure"), "class_weight"
    parts = materialised(failures.stratified_split(ready, "failure", ["host", *names[:3]]), "failure-parts")
    classifier = failures.fit_classifier(parts.where(F.col("part") == "train"), names, "failure", weight)
    judged = failures.failure_scores(classifier, parts.where(F.col("part") == "test"))
    quality = ensemble.supervised_metrics(
        judged.withColumn("model", F.lit("failure_predictor")), "failure", "failure_prediction", ["model"]
    )
    return FailureModel(
        list(metrics), names, parameters, classifier, quality,
        failures.feature_importances(classifier, wide, names),
    )


def predict(wide: DataFrame, model: FailureModel) -> DataFrame:
    """Risk per row of new data; no refitting."""
    made = materialised(datasets.transform_features(wide, model.metrics, model.parameters), "failure-features")
    scored = failures.failure_scores(model.classifier, made)
    return scored.select(
        "host", "clock", "failure_probability", "failure_prediction", "risk_level", "time_to_failure_hours"
    )
