"""Forecast evaluation on given forecasts, and the trained models' own forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.operators import aggregates, chunks, evaluation, quality
from hostpulse.plans import forecasting
from hostpulse.registered import query, rounded
from hostpulse.registered.cleaning import LONG, long
from hostpulse.session import shared_dir
from hostpulse.sources import registry
from hostpulse.sources.tables import AS_OF, METRICS, Tables

_PAIRS = """
actual AS (SELECT host, metric, model, ds, yhat * 1.1 + 1 AS y,
    row_number() OVER (PARTITION BY host, metric, model ORDER BY ds) AS step,
    count(*) OVER (PARTITION BY host, metric, model) AS n FROM forecast),
given AS (SELECT host, metric, model, yhat, row_number() OVER (PARTITION BY host, metric, model ORDER BY ds) AS step,
    count(*) OVER (PARTITION BY host, metric, model) AS n FROM forecast),
pairs AS (SELECT a.host, a.metric, a.model, a.step, y, yhat FROM actual a JOIN given g ON a.host = g.host
  AND a.metric = g.metric AND a.model = g.model AND a.step = g.step AND a.n = g.n)"""
KEY = ["host", "metric", "model"]


def _actual(t: Tables) -> DataFrame:
    return t.written("forecast").select(*KEY, F.col("ds").alias("clock"), (F.col("yhat") * 1.1 + 1).alias("y"))


@query("C8", f"WITH {_PAIRS} SELECT host, metric, model, step, round(y, 6) AS y, yhat FROM pairs")
def forecast_with_actual(t: Tables) -> DataFrame:
    from hostpulse.operators.windows import paired_by_position

    pairs = paired_by_position(_actual(t), t.written("forecast").select(*KEY, "ds", "yhat"), KEY, "clock", "ds")
    return rounded(pairs.select(*KEY, "step", "y", "yhat"), "y")


@query("D15", f"""
WITH {_PAIRS}
SELECT host, metric, model, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) * (y - yhat))), 6) AS rmse,
  round(avg(abs((y - yhat) / (y + 1e-8))) * 100, 6) AS mape FROM pairs GROUP BY ALL
""")
def forecast_errors(t: Tables) -> DataFrame:
    given = t.written("forecast").select(*KEY, "ds", "yhat")
    return rounded(evaluation.forecast_accuracy(_actual(t), given, KEY, "clock", "ds"), "mae", "rmse", "mape")


_CONFIDENCE = """
confidence AS (SELECT host, metric, model,
  greatest(0.0, 1 - avg(yhat_upper - yhat_lower) / (avg(yhat) + 1e-6)) AS confidence_score FROM forecast GROUP BY ALL)"""


@query("J6, E13", f"""
WITH {_CONFIDENCE},
slopes AS (SELECT host, metric, model, count(*) AS points, regr_slope(yhat, rn) AS slope FROM (
  SELECT *, row_number() OVER (PARTITION BY host, metric, model ORDER BY ds) AS rn FROM forecast) GROUP BY ALL)
SELECT c.host, c.metric, c.model, round(confidence_score, 6) AS confidence_score, round(slope, 6) AS slope, points,
  CASE WHEN slope > 0.01 THEN 'increasing' WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend_direction
FROM confidence c JOIN slopes s ON c.host = s.host AND c.metric = s.metric AND c.model = s.model
""")
def forecast_summary(t: Tables) -> DataFrame:
    return rounded(evaluation.forecast_summary(t.written("forecast")), "confidence_score", "slope")


@query("J7", """
WITH stepped AS (SELECT *, row_number() OVER (PARTITION BY host, metric, model ORDER BY ds) AS hour FROM forecast),
typed AS (SELECT *, CASE WHEN metric IN ('system_cpu_util_user', 'vm_memory_utilization') THEN 'percentage'
  WHEN metric = 'system_cpu_load_all_avg1' THEN 'load_average' END AS data_type FROM stepped),
alerted AS (SELECT host, metric, model, hour, yhat AS value,
  CASE WHEN data_type = 'percentage' AND yhat > 90 THEN 'high_utilization'
       WHEN data_type = 'percentage' AND yhat < 5 THEN 'unusually_low'
       WHEN data_type = 'load_average' AND yhat > 4 THEN 'high_load' END AS type FROM typed)
SELECT *, CASE type WHEN 'unusually_low' THEN 'info'
  WHEN 'high_utilization' THEN CASE WHEN value < 95 THEN 'warning' ELSE 'critical' END
  ELSE CASE WHEN value < 8 THEN 'warning' ELSE 'critical' END END AS severity
FROM alerted WHERE type IS NOT NULL
""")
def forecast_alerts(t: Tables) -> DataFrame:
    return evaluation.forecast_alerts(chunks.with_position(t.written("forecast"), KEY, "ds", position="step"))


@query("J8", """
WITH best AS (SELECT host, metric, min(model) AS model FROM forecast GROUP BY ALL)
SELECT f.* FROM forecast f JOIN best b ON f.host = b.host AND f.metric = b.metric AND f.model = b.model
""")
def preferred_forecast(t: Tables) -> DataFrame:
    return evaluation.preferred_model(t.written("forecast"))


@query("D20", f"""
WITH {_CONFIDENCE}
SELECT (SELECT count(*) FROM (SELECT DISTINCT host, measurement FROM hourly)) AS total_metrics,
  (SELECT count(*) FROM (SELECT DISTINCT host, metric FROM confidence)) AS successful_forecasts,
  round(avg(confidence_score), 6) AS average_confidence FROM confidence
""")
def fleet_forecast_summary(t: Tables) -> DataFrame:
    attempted = t.written("hourly").select("host", F.col("measurement").alias("metric"))
    return rounded(evaluation.fleet_summary(evaluation.forecast_confidence(t.written("forecast")), attempted), "average_confidence")


@query("D21", f"""
WITH {LONG},
steps AS (SELECT *, value - lag(value) OVER (PARTITION BY host, measurement ORDER BY clock) AS d FROM long),
q AS (SELECT host, measurement, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL),
scored AS (SELECT s.host, s.measurement, coalesce(least(1.0, greatest(0.0,
  0.4 * count(value) / count(*) + 0.3 * CASE WHEN count(*) > 1 THEN 1 / (1 + stddev_samp(d)) ELSE 0.5 END
  + 0.3 * (1 - count(CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN 1 END) / count(*)::DOUBLE)
  )), 0.0) AS quality_score
FROM steps s JOIN q ON s.host = q.host AND s.measurement = q.measurement GROUP BY s.host, s.measurement)
SELECT host, count(*) AS total_models, round(count(*) / 13.0::DOUBLE, 6) AS model_coverage,
  round(avg(quality_score), 6) AS average_data_quality FROM scored GROUP BY host
""")
def model_coverage(t: Tables) -> DataFrame:
    return rounded(
        evaluation.coverage(quality.series_quality(long(t)), fixed.KEY_METRICS), "model_coverage", "average_data_quality"
    )


@query("J2, J3, J4, H13, H14, H15")
def model_forecasts(t: Tables) -> DataFrame:
    """A day ahead from both models for every series."""
    return forecasting.forecast(forecasting.train(t.written("hourly")), periods=24)


@query("J5")
def trained_forecasters(t: Tables) -> DataFrame:
    """Every series trained on its first four fifths and judged on the rest."""
    return forecasting.evaluated(t.written("hourly"), AS_OF)


@query("J6, J7")
def forecast_reports(t: Tables) -> DataFrame:
    return forecasting.forecast_report(forecasting.train(t.written("hourly")))


@query("A9, A10, J8")
def stored_forecasters(t: Tables) -> DataFrame:
    """Coefficients saved under a version, read back for two metrics, forecast for the dashboard."""
    from hostpulse.operators import additive

    root = shared_dir(t.spark, "forecasters")
    models = forecasting.train(t.written("hourly")).models.withColumn("metric", F.col("measurement"))
    registry.save_version(models, root, "additive", "1.0_20240131_000000")
    loaded = registry.load_version(t.spark, root, "additive", metrics=METRICS[:2])
    rows = additive.forecast(loaded.select(*models.drop("metric").columns), 24)
    named = rows.withColumn("target", F.concat_ws(" ", "host", "measurement"))
    return aggregates.datapoints(named, "target", "yhat", "ds")
