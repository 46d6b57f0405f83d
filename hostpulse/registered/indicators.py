"""Dashboard indicator queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import ensemble, indicators
from hostpulse.registered import query, rounded
from hostpulse.registered.anomalies import CONFIDENCE, DETECTION, SUMMARY, records, scored, summary
from hostpulse.sources.tables import AS_OF, Tables


@query("L1", f"""
WITH {CONFIDENCE}, {SUMMARY}
SELECT host, round(least(100.0, anomaly_rate * 50 + critical * 30 + high * 15), 6) AS risk_level FROM summary
""")
def system_risk(t: Tables) -> DataFrame:
    return rounded(indicators.system_risk(summary(t)), "risk_level")


@query("L2", f"""
WITH {CONFIDENCE}
SELECT host, clock * 1000 AS time, concat(severity, ' Anomaly') AS title,
  concat('Anomaly detected with ', printf('%.2f', confidence_score * 100), '% confidence') AS text,
  concat(lower(severity), ',anomaly') AS tags FROM records
""")
def anomaly_annotations(t: Tables) -> DataFrame:
    return indicators.annotations(records(t)).withColumn("tags", F.array_join("tags", ","))


@query("L3", """
SELECT host, round(avg(CASE WHEN if_flag = lof_flag THEN 1 ELSE 0 END) * 100, 6) AS health_score FROM scores GROUP BY host
""")
def model_health_score(t: Tables) -> DataFrame:
    return rounded(indicators.model_health_score(ensemble.agreement(t.scores)), "health_score")


@query("L4", f"""
WITH {CONFIDENCE}, counts AS (SELECT host, count(*) AS n FROM records GROUP BY host)
SELECT host, (1706659200 - i * 60) * 1000 AS ts_ms, CASE WHEN i = 0 THEN n ELSE 0 END AS value
FROM counts, (SELECT unnest(range(60)) AS i)
""")
def current_anomalies(t: Tables) -> DataFrame:
    return indicators.current_anomalies(records(t), AS_OF)


@query("L6, S11", f"""
WITH {CONFIDENCE}, {DETECTION},
agreement AS (SELECT host, avg(CASE WHEN if_flag = lof_flag THEN 1 ELSE 0 END) AS a FROM scores GROUP BY host)
SELECT m.host, concat(printf('%.2f', anomaly_detection_rate * 100), '%') AS anomaly_detection_rate,
  round(mean_anomaly_score, 3) AS mean_anomaly_score, concat(printf('%.1f', a * 100), '%') AS ensemble_agreement,
  high_confidence_anomalies AS high_confidence, medium_confidence_anomalies AS medium_confidence,
  low_confidence_anomalies AS low_confidence, total_anomalies_detected AS total_detected,
  CASE WHEN a > 0.85 THEN 'excellent' WHEN a > 0.7 THEN 'good' ELSE 'needs_attention' END AS model_health
FROM metrics m JOIN agreement g ON m.host = g.host
""")
def model_report(t: Tables) -> DataFrame:
    return indicators.model_report(ensemble.detection_metrics(scored(t)), ensemble.agreement(t.scores))


@query("L7", """
WITH evaluations AS (SELECT host, clock - clock % 300 AS clock, max(value) AS value FROM samples GROUP BY ALL),
marked AS (SELECT *, value > 20 AS high,
  max(CASE WHEN value <= 20 THEN clock END) OVER (PARTITION BY host ORDER BY clock) AS ok_clock FROM evaluations),
runs AS (SELECT *, min(clock) FILTER (high) OVER (PARTITION BY host, ok_clock) AS start FROM marked)
SELECT host, clock, value, CASE WHEN NOT high THEN 'ok' WHEN clock - start >= 3600 THEN 'firing' ELSE 'pending' END AS state
FROM runs
""")
def alert_rule_states(t: Tables) -> DataFrame:
    """Five-minute evaluations above 20 that must hold for an hour."""
    evaluations = t.samples.groupBy("host", F.expr("clock div 300L * 300L").alias("clock")).agg(F.max("value").alias("value"))
    return indicators.alert_state(evaluations, limit=20, hold=3600).drop("since")
