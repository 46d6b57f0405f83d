"""Baseline, statistical detectors, votes, confidence and detection reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import baseline, ensemble
from hostpulse.registered import query, rounded
from hostpulse.session import materialised
from hostpulse.sources.tables import Tables

BASELINE = """
first_pass AS (SELECT host, measurement, avg(value) AS mean, stddev_samp(value) AS std, median(value) AS median,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM hourly GROUP BY ALL),
second_pass AS (SELECT h.host, h.measurement, median(abs(value - median)) AS mad FROM hourly h
  JOIN first_pass f ON h.host = f.host AND h.measurement = f.measurement GROUP BY ALL),
baseline AS (SELECT f.host, f.measurement, mean, CASE WHEN coalesce(std, 0) = 0 THEN 1e-8 ELSE std END AS std, median,
  CASE WHEN coalesce(mad, 0) = 0 THEN 1e-8 ELSE mad END AS mad, q1, q3,
  CASE WHEN q3 - q1 = 0 THEN 1e-8 ELSE q3 - q1 END AS iqr
  FROM first_pass f JOIN second_pass s ON f.host = s.host AND f.measurement = s.measurement),
compared AS (SELECT h.*, CASE WHEN abs((value - mean) / std) > 3 THEN 1 ELSE 0 END AS z_score,
  CASE WHEN abs(0.6745 * (value - median) / mad) > 3.5 THEN 1 ELSE 0 END AS modified_z_score,
  CASE WHEN value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr THEN 1 ELSE 0 END AS iqr_score,
  least(1.0, greatest(abs((value - mean) / std) / 3.0, abs(0.6745 * (value - median) / mad) / 3.5)) AS contribution
  FROM hourly h JOIN baseline b ON h.host = b.host AND h.measurement = b.measurement),
votes AS (SELECT host, clock, max(z_score) AS z_score, max(modified_z_score) AS modified_z_score,
  max(iqr_score) AS iqr_score,
  CASE WHEN max(z_score) + max(modified_z_score) + max(iqr_score) >= 2 THEN 1 ELSE 0 END AS stat_flag
  FROM compared GROUP BY ALL)"""


def fitted(t: Tables) -> DataFrame:
    """Seven numbers per series, written once because every detector reads them."""
    return materialised(baseline.fit_baseline(t.written("hourly")), "baseline")


@query("D7", f"""
WITH {BASELINE}
SELECT host, measurement, round(COLUMNS(* EXCLUDE (host, measurement)) + 1e-9, 6) FROM baseline
""")
def baseline_statistics(t: Tables) -> DataFrame:
    return rounded(
        baseline.fit_baseline(t.written("hourly")), "mean", "std", "median", "mad", "q1", "q3", "iqr", nudge=1e-9
    )


@query("C7", f"WITH {BASELINE} SELECT host, measurement, clock, value, z_score, modified_z_score, iqr_score FROM compared")
def samples_with_baseline(t: Tables) -> DataFrame:
    return baseline.compared(t.written("hourly"), fitted(t))


@query("I1", f"WITH {BASELINE} SELECT host, clock, z_score FROM votes")
def z_score_flags(t: Tables) -> DataFrame:
    return baseline.moment_flag(t.written("hourly"), fitted(t), "z_score")


@query("I2", f"WITH {BASELINE} SELECT host, clock, modified_z_score FROM votes")
def modified_z_score_flags(t: Tables) -> DataFrame:
    return baseline.moment_flag(t.written("hourly"), fitted(t), "modified_z_score")


@query("I3", f"WITH {BASELINE} SELECT host, clock, iqr_score FROM votes")
def quartile_band_flags(t: Tables) -> DataFrame:
    return baseline.moment_flag(t.written("hourly"), fitted(t), "iqr_score")


@query("I4", f"WITH {BASELINE} SELECT * FROM votes")
def statistical_vote(t: Tables) -> DataFrame:
    return baseline.statistical_vote(t.written("hourly"), fitted(t))


@query("I9", f"WITH {BASELINE} SELECT host, clock, measurement, round(contribution, 6) AS contribution FROM compared")
def anomaly_contributions(t: Tables) -> DataFrame:
    exploded = baseline.explained(t.written("hourly"), fitted(t)).select(
        "host", "clock", F.explode("affected_metrics").alias("measurement", "contribution")
    )
    return rounded(exploded, "contribution")


@query("I13, I4, I9", f"""
WITH {BASELINE}
SELECT v.host, v.clock, round(max(contribution), 6) AS confidence_score,
  CASE WHEN max(contribution) >= 0.8 THEN 'CRITICAL' WHEN max(contribution) >= 0.6 THEN 'HIGH'
       WHEN max(contribution) >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS affected
FROM votes v JOIN compared c ON v.host = c.host AND v.clock = c.clock WHERE stat_flag = 1 GROUP BY v.host, v.clock
""")
def statistical_anomalies(t: Tables) -> DataFrame:
    """Anomaly records of the statistical detector alone; the largest contribution is the confidence."""
    fit = fitted(t)
    votes = baseline.statistical_vote(t.written("hourly"), fit).withColumnRenamed("stat_flag", "is_anomaly")
    causes = baseline.explained(t.written("hourly"), fit)
    scored = votes.join(causes, ["host", "clock"]).withColumn(
        "confidence_score", F.array_max(F.map_values("affected_metrics"))
    )
    records = ensemble.anomaly_records(scored)
    return rounded(
        records.select("host", "clock", "confidence_score", "severity", F.size("affected_metrics").cast("bigint").alias("affected")),
        "confidence_score",
    )


@query("I7", """
SELECT event_id, CASE WHEN if_flag + lof_flag + stat_flag >= 2 THEN 1 ELSE 0 END AS is_anomaly FROM scores
""")
def ensemble_vote(t: Tables) -> DataFrame:
    return ensemble.voted(t.scores).select("event_id", "is_anomaly")


CONFIDENCE = """
ranges AS (SELECT host, min(if_score) AS a, max(if_score) AS b, min(lof_score) AS c, max(lof_score) AS d
           FROM scores GROUP BY host),
scored AS (SELECT s.*, CASE WHEN if_flag + lof_flag + stat_flag >= 2 THEN 1 ELSE 0 END AS is_anomaly,
  ((1 - CASE WHEN b > a THEN (if_score - a) / (b - a) ELSE 0 END)
   + (1 - CASE WHEN d > c THEN (lof_score - c) / (d - c) ELSE 0 END)) / 2 AS confidence_score
  FROM scores s JOIN ranges r ON s.host = r.host),
records AS (SELECT *, CASE WHEN confidence_score >= 0.8 THEN 'CRITICAL' WHEN confidence_score >= 0.6 THEN 'HIGH'
  WHEN confidence_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM scored WHERE is_anomaly = 1)"""


def scored(t: Tables) -> DataFrame:
    return ensemble.with_confidence(ensemble.voted(t.scores))


def records(t: Tables) -> DataFrame:
    return ensemble.anomaly_records(scored(t))


@query("I8", f"WITH {CONFIDENCE} SELECT event_id, round(confidence_score, 6) AS confidence_score FROM scored")
def detection_confidence(t: Tables) -> DataFrame:
    return rounded(scored(t).select("event_id", "confidence_score"), "confidence_score")


@query("F3, S10", f"""
WITH {CONFIDENCE}
SELECT event_id, host, clock, round(confidence_score, 6) AS confidence_score, severity FROM records
ORDER BY confidence_score DESC
""")
def anomalies_by_confidence(t: Tables) -> DataFrame:
    return rounded(records(t), "confidence_score").select("event_id", "host", "clock", "confidence_score", "severity")


@query("B8", f"WITH {CONFIDENCE} SELECT event_id, host, severity FROM records WHERE severity = 'HIGH'")
def anomalies_of_severity(t: Tables) -> DataFrame:
    return ensemble.of_severity(records(t), "high").select("event_id", "host", "severity")


@query("B8", f"""
WITH {CONFIDENCE} SELECT host, count(*) AS filtered_anomaly_count FROM records WHERE severity = 'HIGH' GROUP BY host
""")
def filtered_anomaly_count(t: Tables) -> DataFrame:
    return ensemble.filtered_count(records(t), "HIGH")


DETECTION = """
metrics AS (SELECT host, avg(is_anomaly) AS anomaly_detection_rate, sum(is_anomaly)::BIGINT AS total_anomalies_detected,
  avg(confidence_score) AS mean_anomaly_score, max(confidence_score) AS max_anomaly_score,
  var_pop(confidence_score) AS score_variance, count(*) FILTER (confidence_score > 0.7) AS high_confidence_anomalies,
  count(*) FILTER (confidence_score > 0.4 AND confidence_score <= 0.7) AS medium_confidence_anomalies,
  count(*) FILTER (confidence_score <= 0.4) AS low_confidence_anomalies FROM scored GROUP BY host)"""


@query("D11", f"""
WITH {CONFIDENCE}, {DETECTION}
SELECT * REPLACE (round(anomaly_detection_rate, 6) AS anomaly_detection_rate,
  round(mean_anomaly_score, 6) AS mean_anomaly_score, round(max_anomaly_score, 6) AS max_anomaly_score,
  round(score_variance, 6) AS score_variance) FROM metrics
""")
def detection_metrics(t: Tables) -> DataFrame:
    return rounded(
        ensemble.detection_metrics(scored(t)),
        "anomaly_detection_rate", "mean_anomaly_score", "max_anomaly_score", "score_variance",
    )


@query("D12", """
SELECT host, round(avg(CASE WHEN if_flag = lof_flag THEN 1 ELSE 0 END), 6) AS ensemble_agreement FROM scores GROUP BY host
""")
def detector_agreement(t: Tables) -> DataFrame:
    return rounded(ensemble.agreement(t.scores), "ensemble_agreement")


@query("D14", """
WITH c AS (SELECT host, count(*) FILTER (label = 1 AND stat_flag = 1) AS tp,
  count(*) FILTER (label = 0 AND stat_flag = 1) AS fp, count(*) FILTER (label = 1 AND stat_flag = 0) AS fn,
  avg(CASE WHEN label = stat_flag THEN 1 ELSE 0 END) AS accuracy FROM scores GROUP BY host)
SELECT host, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1_score, round(accuracy, 6) AS accuracy FROM c
""")
def supervised_metrics(t: Tables) -> DataFrame:
    return rounded(
        ensemble.supervised_metrics(t.scores, "label", "stat_flag"), "precision", "recall", "f1_score", "accuracy"
    )


SUMMARY = """
totals AS (SELECT host, count(*) AS total_samples FROM scored GROUP BY host),
found AS (SELECT host, count(*) AS anomaly_count, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, max(confidence_score) AS highest FROM records GROUP BY host),
summary AS (SELECT t.host, total_samples, coalesce(anomaly_count, 0) AS anomaly_count, coalesce(critical, 0) AS critical,
  coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low,
  coalesce(highest, 0.0) AS highest_confidence, coalesce(critical, 0) > 0 AS has_critical_anomalies,
  coalesce(anomaly_count, 0) / total_samples AS anomaly_rate FROM totals t LEFT JOIN found f ON t.host = f.host)"""


def summary(t: Tables) -> DataFrame:
    all_rows = scored(t)
    totals = all_rows.groupBy("host").agg(F.count("*").alias("total_samples"))
    return ensemble.anomaly_summary(ensemble.anomaly_records(all_rows), totals)


@query("D16", f"""
WITH {CONFIDENCE}, {SUMMARY}
SELECT * REPLACE (round(highest_confidence, 6) AS highest_confidence, round(anomaly_rate, 6) AS anomaly_rate) FROM summary
""")
def anomaly_summary(t: Tables) -> DataFrame:
    return rounded(summary(t), "highest_confidence", "anomaly_rate")
