"""Data-quality scores and training-data profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.operators.cleaning import iqr_bounds
from hostpulse.operators.windows import changed

SERIES = ("host", "measurement")


def frame_quality(
    wide: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = ("host",),
    outlier: str | None = None,
) -> DataFrame:
    """Completeness, consistency and accuracy in percent, and their mean.

    Completeness is the share of known cells, consistency the share of numeric columns,
    accuracy the share of rows whose 0/1 column ``outlier`` is 0 (100 when there is none,
    or for ten rows or fewer).
    """
    numeric = [c for c, t in wide.dtypes if c in columns and (t in ("int", "bigint", "double", "float") or t[:7] == "decimal")]
    known = sum((F.count(c) for c in columns), F.lit(0))
    cells = F.count("*") * len(columns)
    inliers = F.avg((F.col(outlier) == 0).cast("double")) * 100 if outlier else F.lit(100.0)
    scores = wide.groupBy(*by).agg(
        (known / cells * 100).alias("completeness"),
        F.lit(len(numeric) / len(columns) * 100).alias("consistency"),
        F.when(F.count("*") > 10, inliers).otherwise(F.lit(100.0)).alias("accuracy"),
    )
    overall = (F.col("completeness") + F.col("consistency") + F.col("accuracy")) / 3
    return scores.select(
        *by,
        F.round("completeness", 2).alias("completeness"),
        F.round("consistency", 2).alias("consistency"),
        F.round("accuracy", 2).alias("accuracy"),
        F.round(overall, 2).alias("overall_score"),
    )


def series_quality(df: DataFrame, by: Sequence[str] = SERIES, clock: str = "clock") -> DataFrame:
    """Score from 0 to 1: known share, steadiness of changes, and share inside a wide band."""
    steps = changed(df, by=by, clock=clock).groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count("value").alias("known"),
        F.stddev_samp("value_diff").alias("step_std"),
    )
    bounds = iqr_bounds(df, fixed.QUALITY_IQR_FACTOR, by)
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    outliers = df.join(bounds, list(by)).groupBy(*by).agg(F.count_if(outside).alias("outliers"))
    completeness = F.col("known") / F.col("rows")
    consistency = F.when(F.col("rows") > 1, F.lit(1.0) / (F.lit(1.0) + F.col("step_std"))).otherwise(0.5)
    inside = F.lit(1.0) - F.coalesce("outliers", F.lit(0)) / F.col("rows")
    a, b, c = fixed.QUALITY_WEIGHTS
    score = completeness * a + consistency * b + inside * c
    return steps.join(outliers, list(by), "left").select(
        *by, "rows", F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), F.lit(0.0)).alias("quality_score")
    ).withColumn("quality_score", F.when(F.col("rows") > 0, F.col("quality_score")))


def training_profile(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """Rows, share missing, and mean, std, min and max per series; unknown figures are 0."""
    def zero(c):
        return F.coalesce(c, F.lit(0.0))

    return df.groupBy(*by).agg(
        F.count("*").alias("sample_count"),
        ((F.count("*") - F.count("value")) / F.count("*") * 100).alias("missing_values_pct"),
        zero(F.avg("value")).alias("mean"),
        zero(F.stddev_samp("value")).alias("std"),
        zero(F.min("value")).alias("min"),
        zero(F.max("value")).alias("max"),
    )
