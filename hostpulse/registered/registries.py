"""Model registry queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import baseline
from hostpulse.registered import query, rounded
from hostpulse.registered.anomalies import BASELINE
from hostpulse.session import shared_dir
from hostpulse.sources import registry
from hostpulse.sources.tables import AS_OF, Tables


@query("L5", """
WITH latest AS (SELECT model_name, max(version) AS version, arg_max(training_samples, version) AS n FROM registry GROUP BY ALL),
aged AS (SELECT *, (1706659200 - epoch(strptime(regexp_extract(version, '(\\d{8}_\\d{6})$', 1), '%Y%m%d_%H%M%S'))) / 3600.0::DOUBLE
  AS age FROM latest)
SELECT model_name, version, round(age, 1) AS hours_since_training, true AS ready_for_detection,
       age > 4 AS needs_retraining, age < 24 AS retrain_skipped FROM aged
""")
def registry_status(t: Tables) -> DataFrame:
    return registry.registry_status(t.registry, AS_OF).drop("training_samples")


@query("L5", """
WITH latest AS (SELECT model_name, max(version) AS version FROM registry GROUP BY ALL),
aged AS (SELECT (1706659200 - epoch(strptime(regexp_extract(version, '(\\d{8}_\\d{6})$', 1), '%Y%m%d_%H%M%S'))) / 3600.0::DOUBLE
  AS age FROM latest)
SELECT count(*) AS current_models, round(max(age), 1) AS oldest_model_hours, max(age) > 4 AS needs_retraining FROM aged
""")
def refresh_status(t: Tables) -> DataFrame:
    return registry.refresh_status(t.registry, AS_OF)


@query("M7", """
WITH wanted(model_name) AS (VALUES ('system_cpu_util'), ('system_cpu_util_user'), ('system_cpu_load_all_avg1'),
  ('vm_memory_utilization')),
latest AS (SELECT model_name, max(version) AS version FROM registry GROUP BY ALL)
SELECT w.model_name, version, CASE WHEN version IS NULL THEN 'missing' ELSE 'stale' END AS reason
FROM wanted w LEFT JOIN latest l ON w.model_name = l.model_name
WHERE version IS NULL
  OR 1706659200 - epoch(strptime(regexp_extract(version, '(\\d{8}_\\d{6})$', 1), '%Y%m%d_%H%M%S')) > 4 * 3600
""")
def models_to_refresh(t: Tables) -> DataFrame:
    return registry.models_to_refresh(t.registry, AS_OF)


@query("A7, A8", f"WITH {BASELINE} SELECT host, measurement, round(mean + 1e-9, 6) AS mean, 'v2' AS version FROM baseline")
def model_registry_round_trip(t: Tables) -> DataFrame:
    """Two versions of the baseline model saved; the latest read back."""
    root = shared_dir(t.spark, "models")
    fitted = baseline.fit_baseline(t.hourly)
    registry.save_version(fitted.withColumn("mean", F.col("mean") - 1), root, "baseline", "v1")
    registry.save_version(fitted, root, "baseline", "v2")
    latest = registry.load_version(t.spark, root, "baseline")
    return rounded(latest.select("host", "measurement", "mean", "version"), "mean", nudge=1e-9)
