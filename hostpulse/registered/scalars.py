"""Label and mapping queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions import labels
from hostpulse.registered import query
from hostpulse.sources.tables import AS_OF, Tables

_SEVERITY = "CASE WHEN {x} >= 0.8 THEN 'CRITICAL' WHEN {x} >= 0.6 THEN 'HIGH' WHEN {x} >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END"


@query("S10", f"SELECT event_id, if_score, {_SEVERITY.format(x='if_score')} AS severity FROM scores")
def severity_labels(t: Tables) -> DataFrame:
    return t.scores.select("event_id", "if_score", labels.severity(F.col("if_score")).alias("severity"))


@query("S11", """
SELECT event_id, CASE WHEN if_score > 0.85 THEN 'excellent' WHEN if_score > 0.7 THEN 'good' ELSE 'needs_attention' END
  AS model_health FROM scores
""")
def model_health_labels(t: Tables) -> DataFrame:
    return t.scores.select("event_id", labels.model_health(F.col("if_score")).alias("model_health"))


_BANDS = ", ".join(
    f"('{p}', {'-1e308' if low is None else low}::DOUBLE, '{colour}')" for p, low, colour in fixed.PANEL_BANDS
)


@query("S12", f"""
SELECT event_id, panel, arg_max(colour, low) AS colour
FROM base JOIN (VALUES {_BANDS}) b(panel, low, colour)
  ON CASE WHEN panel = 'uptime' THEN value * 400 ELSE value END >= low
GROUP BY event_id, panel
""")
def panel_bands(t: Tables) -> DataFrame:
    """Every sample under every panel's bands; uptime takes the value as hundreds of seconds."""
    panels = F.array(*[F.lit(p) for p in dict.fromkeys(p for p, _, _ in fixed.PANEL_BANDS)])
    each = t.base.select("event_id", "value", F.explode(panels).alias("panel"))
    shown = F.when(F.col("panel") == "uptime", F.col("value") * 400).otherwise(F.col("value"))
    return each.select("event_id", "panel", labels.panel_band(F.col("panel"), shown).alias("colour"))


@query("S15", """
SELECT DISTINCT metric,
  CASE WHEN contains(lower(metric), 'cpu') THEN CASE WHEN contains(metric, 'system_cpu_util') THEN 'prediction_system_cpu_util'
         WHEN contains(metric, 'system_cpu_load') THEN 'prediction_cpu_load_avg' END
       WHEN contains(lower(metric), 'memory') THEN 'prediction_memory_util' END AS search_target,
  CASE WHEN regexp_matches(lower(metric), 'cpu|processor') THEN 'prediction_cpu_util'
       WHEN regexp_matches(lower(metric), 'memory|ram|mem') THEN 'prediction_memory_util'
       WHEN regexp_matches(lower(metric), 'disk|fs|filesystem') THEN 'prediction_disk_util' END AS discovery_target
FROM forecast
""")
def dashboard_targets(t: Tables) -> DataFrame:
    metric = F.col("metric")
    return t.forecast.select("metric").distinct().select(
        "metric",
        labels.search_target(metric).alias("search_target"),
        labels.discovery_target(metric).alias("discovery_target"),
    )


@query("S16", """
SELECT model_name, version, epoch(strptime(regexp_extract(version, '(\\d{8}_\\d{6})$', 1), '%Y%m%d_%H%M%S'))::BIGINT AS trained,
       round((1706659200 - epoch(strptime(regexp_extract(version, '(\\d{8}_\\d{6})$', 1), '%Y%m%d_%H%M%S'))) / 3600.0::DOUBLE, 6)
         AS age_hours
FROM registry
""")
def model_ages(t: Tables) -> DataFrame:
    version = F.col("version")
    return t.registry.select(
        "model_name",
        "version",
        labels.version_epoch(version).alias("trained"),
        F.round(labels.version_age_hours(version, AS_OF), 6).alias("age_hours"),
    )


@query("S17", """
SELECT event_id, CASE stat_flag WHEN 0 THEN 'NO MODEL' WHEN 1 THEN 'ACTIVE' END AS model_status,
  CASE event_id % 101 WHEN 0 THEN 'LOW' WHEN 25 THEN 'MEDIUM' WHEN 50 THEN 'HIGH' WHEN 75 THEN 'CRITICAL' END AS risk_code,
  CASE WHEN event_id % 101 >= 75 THEN 'CRITICAL' WHEN event_id % 101 >= 50 THEN 'HIGH'
       WHEN event_id % 101 >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band
FROM scores
""")
def code_texts(t: Tables) -> DataFrame:
    level = F.col("event_id") % 101
    return t.scores.select(
        "event_id",
        labels.model_status_text(F.col("stat_flag")).alias("model_status"),
        labels.risk_code_text(level).alias("risk_code"),
        labels.risk_band_text(level).alias("risk_band"),
    )
