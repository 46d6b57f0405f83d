"""Training sets and the fitted feature pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import aggregates, cleaning, features, intervals, quality, relations
from hostpulse.session import materialised
from hostpulse.sources import samples as scans

CALENDAR = ["hour", "day_of_week", "is_weekend", "is_business_hours", "hour_sin", "hour_cos", "day_sin", "day_cos"]


def pipeline_features(metrics: Sequence[str]) -> list[str]:
    """Names of the feature pipeline's output columns, in order."""
    statistical = [n for c in metrics for n in features.statistical_names(c)]
    return [*metrics, *CALENDAR, *statistical, *features.domain_names(metrics)]


IMPUTERS = ("median", "neighbours")


def _imputed(
    wide: DataFrame, metrics: Sequence[str], params: DataFrame, by: Sequence[str], clock: str, reference: DataFrame | None = None
) -> DataFrame:
    """Gaps filled from the nearest rows of ``reference`` where it is given, else and then by medians, else by 0."""
    known_metrics = [c for c in metrics if c in wide.columns]
    if reference is not None and known_metrics:
        from hostpulse.operators.neighbours import knn_imputed

        wide = knn_imputed(wide, known_metrics, by=by, clock=clock, reference=reference)
    medians = params.select(*by, *[f"{c}__median" for c in metrics])
    known = set(wide.columns)

    def value(c: str) -> Column:
        return F.coalesce(F.col(c), F.col(f"{c}__median"), F.lit(0.0)) if c in known else F.lit(0.0)

    return wide.join(medians, list(by), "left").select(*by, clock, *[value(c).alias(c) for c in metrics])


def _made(full: DataFrame, metrics: Sequence[str], params: DataFrame, by: Sequence[str], clock: str) -> DataFrame:
    fitted = params.select(*by, *[f"{c}__{p}" for c in metrics for p in ("mean", "std", "varies")])
    made = features.statistical_set(features.calendar_set(full, clock), metrics, fitted, by, clock)
    return cleaning.aligned(features.domain_set(made, metrics), pipeline_features(metrics), [*by, clock])


def fit_features(
    wide: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("host",), clock: str = "clock", imputer: str = "median"
) -> tuple[DataFrame, DataFrame]:
    """Fit the feature pipeline and transform its training data.

    ``imputer`` is ``median``, or ``neighbours`` for the mean of the five nearest rows; then
    ``transform_features`` needs the same ``wide`` as its reference.

    Returns the parameters - one row per key with medians, means, stds, and robust centre
    and scale per feature - and the scaled features. Imputed metrics and unscaled features
    are written once each, since fitting and transforming both read them.
    """
    medians = materialised(cleaning.median_parameters(wide, metrics, by), "feature-medians")
    if imputer not in IMPUTERS:
        raise ValueError(f"imputer must be one of {IMPUTERS}")
    reference = wide if imputer == "neighbours" else None
    full = materialised(_imputed(wide, metrics, medians, by, clock, reference), "imputed")
    stats = materialised(medians.join(features.series_parameters(full, metrics, by, clock), list(by)), "feature-stats")
    made = materialised(_made(full, metrics, stats, by, clock), "unscaled-features")
    names = pipeline_features(metrics)
    scaling = cleaning.fit_scaling(made, names, "robust", by)
    params = materialised(stats.join(scaling, list(by)), "feature-parameters")
    return params, cleaning.scaled(made, names, params.select(*by, "centers", "scales"), by)


def transform_features(
    wide: DataFrame, metrics: Sequence[str], params: DataFrame, by: Sequence[str] = ("host",), clock: str = "clock",
    reference: DataFrame | None = None,
) -> DataFrame:
    """Features of new data under fitted parameters. Metrics the data lacks count as 0.0, extra ones are dropped.

    ``reference`` is the data the parameters were fitted on, where they were fitted with neighbours.
    """
    made = _made(_imputed(wide, metrics, params, by, clock, reference), metrics, params, by, clock)
    return cleaning.scaled(made, pipeline_features(metrics), params.select(*by, "centers", "scales"), by)


def labelled_dataset(
    wide: DataFrame,
    metrics: Sequence[str],
    alerts: DataFrame | None,
    minutes: Sequence[int],
    by: Sequence[str] = ("host",),
    clock: str = "clock",
) -> DataFrame:
    """Cleaned, enriched, standardised features with an anomaly label (0 without alerts)."""
    steady = materialised(cleaning.clean_wide(wide, metrics, by, clock), "cleaned")
    made = materialised(features.rolling_lag_set(steady, metrics, minutes, by=by, clock=clock), "rolling-features")
    columns = [c for c in made.columns if c not in (*by, clock)]
    ready = cleaning.scaled(made, columns, cleaning.fit_scaling(made, columns, "standard", by), by)
    if alerts is None:
        return ready.withColumn("is_anomaly", F.lit(0))
    return intervals.label_anomalies(ready, alerts, by=by, clock=clock)


@dataclass(frozen=True)
class TrainingData:
    metrics: DataFrame
    alerts: DataFrame | None
    quality: DataFrame


def collect_training_data(
    samples: DataFrame,
    as_of: int,
    hours: int = 168,
    measurements: Sequence[str] | None = None,
    hosts: Sequence[str] | None = None,
    relations_of_alerts: dict[str, DataFrame] | None = None,
) -> TrainingData:
    """Wide metrics of the last hours, alerts of the days they span plus one, and a quality score per host."""
    from hostpulse.functions import fixed_values as fixed

    names = list(measurements or fixed.KEY_METRICS)
    wide = aggregates.to_wide(scans.scan_history(samples, as_of, hours, hosts, names), names)
    alerts = None
    if relations_of_alerts is not None:
        days = hours // 24 + 1
        alerts = relations.alert_history(**relations_of_alerts, since=as_of - days * 86400)
    return TrainingData(wide, alerts, quality.frame_quality(wide, names))
