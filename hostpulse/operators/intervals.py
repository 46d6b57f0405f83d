"""Interval joins: which samples lie near an alert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mark_near(
    samples: DataFrame,
    alerts: DataFrame,
    before: int,
    after: int,
    label: str,
    by: Sequence[str] = ("host",),
    clock: str = "clock",
    alert_clock: str = "alert_clock",
) -> DataFrame:
    """Add 0/1 ``label``: some alert a has ``a - before <= clock <= a + after`` (both ends closed).

    Existence, so alerts need not be paired with samples. Time is cut into buckets of the
    interval's width; an alert is sent to the two or three buckets its interval touches and
    each bucket keeps, per place the interval enters it, only one covering range. Within a
    bucket every interval covers a prefix, a suffix or all of it, or - where it lies inside -
    is at least as wide as the bucket, so the reach from the left edge (largest end of
    intervals that start at or before the bucket) and the reach from the right edge
    (smallest start of intervals that end at or after its end) decide each sample.
    One row per (key, bucket) joins, however many alerts fall into it.
    """
    width = before + after
    reached = alerts.select(
        *by,
        (F.col(alert_clock) - before).alias("_from"),
        (F.col(alert_clock) + after).alias("_to"),
    ).select("*", F.explode(F.expr(f"sequence(_from div {width}L, _to div {width}L)")).alias("_bucket"))
    start = F.col("_bucket") * width
    edges = reached.groupBy(*by, "_bucket").agg(
        F.max(F.when(F.col("_from") <= start, F.col("_to"))).alias("_left_reach"),
        F.min(F.when(F.col("_to") >= start + (width - 1), F.col("_from"))).alias("_right_reach"),
    )
    bucketed = samples.withColumn("_bucket", F.expr(f"`{clock}` div {width}L"))
    near = (F.col(clock) <= F.col("_left_reach")) | (F.col(clock) >= F.col("_right_reach"))
    return bucketed.join(edges, [*by, "_bucket"], "left").select(
        *samples.columns, F.coalesce(near, F.lit(False)).cast("int").alias(label)
    )


def label_anomalies(samples: DataFrame, alerts: DataFrame, minutes: int = 30, **kw: object) -> DataFrame:
    """Samples within half an hour of an alert are anomalous."""
    return mark_near(samples, alerts, before=minutes * 60, after=minutes * 60, label="is_anomaly", **kw)


def label_failures(samples: DataFrame, alerts: DataFrame, hours: int = 2, **kw: object) -> DataFrame:
    """Samples in the two hours before an alert, or at it, precede a failure."""
    return mark_near(samples, alerts, before=hours * 3600, after=0, label="failure", **kw)
