"""Statistical baseline per series and the detectors that compare samples with it.

Works in long form: one join with a small parameter table, then one aggregation per
(host, time) whose groups are as large as a host has metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions.numeric import finite, floored_spread
from hostpulse.operators.quantiles import exact_quantiles

SERIES = ("host", "measurement")
MOMENT = ("host", "clock")


def fit_baseline(df: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """mean, std, median, mad, q1, q3 and iqr per series; spreads of 0 get a tiny value."""
    first = exact_quantiles(
        df, by, "value", [0.25, 0.5, 0.75],
        also=[F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")],
    ).where(F.col("mean").isNotNull())
    q = F.col("quantiles")
    centre = first.select(*by, q[1].alias("_median"))
    away = df.join(centre, list(by)).select(*by, F.abs(F.col("value") - F.col("_median")).alias("_away"))
    mad = exact_quantiles(away, by, "_away", [0.5], output="_mad")
    return first.join(mad, list(by)).select(
        *by,
        "mean",
        floored_spread(F.col("std")).alias("std"),
        q[1].alias("median"),
        floored_spread(F.col("_mad")[0]).alias("mad"),
        q[0].alias("q1"),
        q[2].alias("q3"),
        floored_spread(q[2] - q[0]).alias("iqr"),
    )


def _z() -> Column:
    return F.abs((F.col("value") - F.col("mean")) / F.col("std"))


def _modified_z() -> Column:
    return F.abs((F.col("value") - F.col("median")) * fixed.MODIFIED_Z_SCALE / F.col("mad"))


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def compared(
    df: DataFrame, baseline: DataFrame, by: Sequence[str] = SERIES, iqr_factor: float = fixed.IQR_FACTOR
) -> DataFrame:
    """Each sample with its three flags. Series without a baseline fall out."""
    band = F.col("iqr") * iqr_factor
    outside = (F.col("value") < F.col("q1") - band) | (F.col("value") > F.col("q3") + band)
    return df.join(baseline, list(by)).select(
        *df.columns,
        _flag(finite(_z()) > fixed.Z_LIMIT).alias("z_score"),
        _flag(finite(_modified_z()) > fixed.MODIFIED_Z_LIMIT).alias("modified_z_score"),
        _flag(outside).alias("iqr_score"),
    )


def moment_flag(df: DataFrame, baseline: DataFrame, method: str, at: Sequence[str] = MOMENT) -> DataFrame:
    """Is any metric of a moment flagged by one method."""
    return compared(df, baseline).groupBy(*at).agg(F.max(method).alias(method))


def statistical_vote(df: DataFrame, baseline: DataFrame, at: Sequence[str] = MOMENT, needed: int = 2) -> DataFrame:
    """The three flags per moment and whether at least two agree."""
    methods = ["z_score", "modified_z_score", "iqr_score"]
    flags = compared(df, baseline).groupBy(*at).agg(*[F.max(m).alias(m) for m in methods])
    total = F.col("z_score") + F.col("modified_z_score") + F.col("iqr_score")
    return flags.withColumn("stat_flag", (total >= needed).cast("int"))


def contributions(df: DataFrame, baseline: DataFrame, by: Sequence[str] = SERIES) -> DataFrame:
    """How far each sample is from normal, from 0 to 1; unknown values count as 0."""
    known = df.withColumn("value", F.coalesce(finite(F.col("value")), F.lit(0.0)))
    worst = F.greatest(_z() / fixed.Z_LIMIT, _modified_z() / fixed.MODIFIED_Z_LIMIT)
    return known.join(baseline, list(by)).select(*df.columns, F.least(F.lit(1.0), worst).alias("contribution"))


def explained(df: DataFrame, baseline: DataFrame, at: Sequence[str] = MOMENT) -> DataFrame:
    """Map metric to contribution per moment, as many entries as a host has metrics."""
    return contributions(df, baseline).groupBy(*at).agg(
        F.map_from_entries(F.collect_list(F.struct("measurement", "contribution"))).alias("affected_metrics")
    )
