"""Votes, confidence, detection reports and filters over detector outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions.labels import severity

HOST = ("host",)


def voted(df: DataFrame, flags: Sequence[str] = ("if_flag", "lof_flag", "stat_flag"), needed: int = 2) -> DataFrame:
    """Anomaly where at least ``needed`` detectors say so."""
    total = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return df.withColumn("is_anomaly", (total >= needed).cast("int"))


def score_ranges(df: DataFrame, scores: Sequence[str] = ("if_score", "lof_score"), by: Sequence[str] = HOST) -> DataFrame:
    """Smallest and largest score per key; from training data these make scores comparable across batches."""
    return df.groupBy(*by).agg(
        *[F.min(s).alias(f"{s}_min") for s in scores], *[F.max(s).alias(f"{s}_max") for s in scores]
    )


def with_confidence(
    df: DataFrame,
    scores: Sequence[str] = ("if_score", "lof_score"),
    by: Sequence[str] = HOST,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """Mean of the inverted, range-scaled scores; low scores are anomalous.

    The range is the scored batch's own unless training ranges are given.
    """
    ranges = score_ranges(df, scores, by) if ranges is None else ranges

    def inverted(s: str) -> Column:
        width = F.col(f"{s}_max") - F.col(f"{s}_min")
        share = F.when(width > 0, (F.col(s) - F.col(f"{s}_min")) / width).otherwise(0.0)
        return F.lit(1.0) - F.least(F.lit(1.0), F.greatest(F.lit(0.0), share))

    mean = sum((inverted(s) for s in scores[1:]), inverted(scores[0])) / len(scores)
    return df.join(ranges, list(by)).select(*df.columns, mean.alias("confidence_score"))


def anomaly_records(scored: DataFrame, explanations: DataFrame | None = None, at: Sequence[str] = ("host", "clock")) -> DataFrame:
    """Anomalous rows with severity and, if given, the metrics behind them; highest confidence first."""
    hits = scored.where(F.col("is_anomaly") == 1).withColumn("severity", severity(F.col("confidence_score")))
    if explanations is not None:
        hits = hits.join(explanations, list(at), "left")
    return hits.orderBy(F.col("confidence_score").desc(), *at)


def of_severity(records: DataFrame, level: str | None) -> DataFrame:
    """Records of one severity; an unknown level filters nothing."""
    known = [label for _, label in fixed.SEVERITY_LEVELS] + [fixed.LOWEST_SEVERITY]
    if level is None or level.upper() not in known:
        return records
    return records.where(F.col("severity") == level.upper())


def filtered_count(records: DataFrame, level: str | None, by: Sequence[str] = HOST) -> DataFrame:
    return of_severity(records, level).groupBy(*by).agg(F.count("*").alias("filtered_anomaly_count"))


def detection_metrics(df: DataFrame, by: Sequence[str] = HOST) -> DataFrame:
    c = F.col("confidence_score")
    return df.groupBy(*by).agg(
        F.avg("is_anomaly").alias("anomaly_detection_rate"),
        F.sum("is_anomaly").cast("bigint").alias("total_anomalies_detected"),
        F.avg(c).alias("mean_anomaly_score"),
        F.max(c).alias("max_anomaly_score"),
        F.var_pop(c).alias("score_variance"),
        F.count_if(c > 0.7).alias("high_confidence_anomalies"),
        F.count_if((c > 0.4) & (c <= 0.7)).alias("medium_confidence_anomalies"),
        F.count_if(c <= 0.4).alias("low_confidence_anomalies"),
    )


def agreement(df: DataFrame, a: str = "if_flag", b: str = "lof_flag", by: Sequence[str] = HOST) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(a) == F.col(b)).cast("int")).alias("ensemble_agreement"))


def supervised_metrics(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = HOST) -> DataFrame:
    """Precision, recall, F1 and accuracy; a division by zero gives 0."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).alias("_tp"), F.count_if(~t & p).alias("_fp"), F.count_if(t & ~p).alias("_fn"),
        F.avg((F.col(truth) == F.col(predicted)).cast("int")).alias("accuracy"),
    )

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return counts.select(
        *by,
        share(F.col("_tp"), F.col("_tp") + F.col("_fp")).alias("precision"),
        share(F.col("_tp"), F.col("_tp") + F.col("_fn")).alias("recall"),
        share(F.col("_tp") * 2, F.col("_tp") * 2 + F.col("_fp") + F.col("_fn")).alias("f1_score"),
        "accuracy",
    )


def silhouette(df: DataFrame, features: Sequence[str], label: str = "is_anomaly", minimum: int = 10) -> DataFrame:
    """Separation of normal and anomalous rows, by squared Euclidean distance, as one row.

    The library's evaluator needs two passes of sums per label, never pairs of rows. There
    is no score for ``minimum`` rows or fewer, or with a single label.
    """
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    counts = df.agg(F.count("*").alias("rows"), F.count_distinct(label).alias("labels")).first()
    score = None
    if counts["rows"] > minimum and counts["labels"] > 1:
        points = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(
            df.withColumn("prediction", F.col(label).cast("int"))
        )
        score = float(ClusteringEvaluator(predictionCol="prediction").evaluate(points))
    return spark.createDataFrame([(int(counts["rows"]), score)], "rows bigint, silhouette_score double")


def anomaly_summary(records: DataFrame, totals: DataFrame, by: Sequence[str] = HOST) -> DataFrame:
    """Counts per severity, highest confidence, critical flag and rate. ``totals``: key, total_samples."""
    s = F.col("severity")
    found = records.groupBy(*by).agg(
        F.count("*").alias("anomaly_count"),
        *[F.count_if(s == level).alias(level.lower()) for level in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.max("confidence_score").alias("highest_confidence"),
    )
    zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("anomaly_count", "critical", "high", "medium", "low")}
    return totals.join(found, list(by), "left").select(
        *by,
        "total_samples",
        *zero.values(),
        F.coalesce("highest_confidence", F.lit(0.0)).alias("highest_confidence"),
        (F.coalesce("critical", F.lit(0)) > 0).alias("has_critical_anomalies"),
        F.coalesce(F.try_divide(F.coalesce("anomaly_count", F.lit(0)), F.col("total_samples")), F.lit(0.0)).alias(
            "anomaly_rate"
        ),
    )
