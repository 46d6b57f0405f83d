"""Dashboard indicators: risk, annotations, health, current anomalies, reports, alert rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.functions.labels import model_health
from hostpulse.operators import chunks
from hostpulse.operators.windows import SERIES

HOST = ("host",)


def system_risk(summary: DataFrame, by: Sequence[str] = HOST) -> DataFrame:
    """0 to 100 from anomaly rate and the numbers of critical and high anomalies; no data gives 0."""
    raw = F.col("anomaly_rate") * 50 + F.col("critical") * 30 + F.col("high") * 15
    return summary.select(*by, F.least(F.lit(100.0), F.coalesce(raw, F.lit(0.0))).alias("risk_level"))


def annotations(records: DataFrame, clock: str = "clock", by: Sequence[str] = HOST) -> DataFrame:
    return records.select(
        *by,
        (F.col(clock) * 1000).alias("time"),
        F.concat("severity", F.lit(" Anomaly")).alias("title"),
        F.concat(
            F.lit("Anomaly detected with "), percent_text(F.col("confidence_score"), 2), F.lit(" confidence")
        ).alias("text"),
        F.array(F.lower("severity"), F.lit("anomaly")).alias("tags"),
    )


def percent_text(share: Column, digits: int) -> Column:
    """Percent with ties rounded to even, as people's reports format it."""
    return F.format_string(f"%.{digits}f%%", F.bround(share * 100, digits))


def model_health_score(agreement: DataFrame, by: Sequence[str] = HOST) -> DataFrame:
    """Detector agreement in percent; without a model 0."""
    return agreement.select(*by, (F.coalesce("ensemble_agreement", F.lit(0.0)) * 100).alias("health_score"))


def current_anomalies(records: DataFrame, as_of: int, minutes: int = 60, by: Sequence[str] = HOST) -> DataFrame:
    """One point per minute of the last hour: the total in the newest, 0 in the others."""
    from hostpulse.operators.aggregates import minute_spine

    return minute_spine(as_of, records.groupBy(*by).agg(F.count("*").alias("value")), "value", minutes, by)


def model_report(metrics: DataFrame, agreement: DataFrame, by: Sequence[str] = HOST) -> DataFrame:
    """Detection metrics as shown to people."""
    return metrics.join(agreement, list(by)).select(
        *by,
        percent_text(F.col("anomaly_detection_rate"), 2).alias("anomaly_detection_rate"),
        F.round("mean_anomaly_score", 3).alias("mean_anomaly_score"),
        percent_text(F.col("ensemble_agreement"), 1).alias("ensemble_agreement"),
        F.col("high_confidence_anomalies").alias("high_confidence"),
        F.col("medium_confidence_anomalies").alias("medium_confidence"),
        F.col("low_confidence_anomalies").alias("low_confidence"),
        F.col("total_anomalies_detected").alias("total_detected"),
        model_health(F.col("ensemble_agreement")).alias("model_health"),
    )


def alert_state(
    evaluations: DataFrame,
    limit: float = 5,
    hold: int = 300,
    by: Sequence[str] = HOST,
    clock: str = "clock",
    value: str = "value",
) -> DataFrame:
    """State of a threshold rule per evaluation: ok, pending, or firing once it held for ``hold`` seconds,
    and ``since``, the start of the run of true evaluations.

    It fires when the condition held at every evaluation of the preceding ``hold`` seconds
    and the run of true evaluations is at least that long. A run's start is the first
    evaluation after the last false one, carried across chunks.
    """
    marked = evaluations.withColumn("_high", F.col(value) > limit)
    last_ok = F.when(~F.col("_high"), F.lit(1))
    before = chunks.with_neighbours(marked.withColumn("_ok", last_ok), by, clock, ["_ok"])
    ok_clock = F.col("_prev__ok.clock")
    runs = before.select(*evaluations.columns, "_high", ok_clock.alias("_ok_clock"))
    keyed = [*by, "_ok_clock"]
    starts = runs.where("_high").groupBy(*keyed).agg(F.min(clock).alias("_start"))
    joined = runs.alias("r").join(
        starts.alias("s"),
        [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keyed],
        "left",
    ).select(*[F.col(f"r.{c}") for c in evaluations.columns], F.col("r._high"), F.col("s._start"))
    state = F.when(~F.col("_high"), "ok").when(F.col(clock) - F.col("_start") >= hold, "firing").otherwise("pending")
    since = F.when(F.col("_high"), F.col("_start"))
    return joined.select(*evaluations.columns, state.alias("state"), since.alias("since"))
