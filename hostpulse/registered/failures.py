"""Failure prediction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import cleaning, failures, intervals, neighbours
from hostpulse.plans import failure_prediction
from hostpulse.registered import query, rounded
from hostpulse.session import materialised
from hostpulse.sources.tables import METRICS, Tables

_RISK = """CASE WHEN if_score >= 0.8 THEN 'CRITICAL' WHEN if_score >= 0.6 THEN 'HIGH' WHEN if_score >= 0.4 THEN 'MEDIUM'
  ELSE 'LOW' END"""
_SCORED = f"""scored AS (SELECT event_id, if_score AS p, {_RISK} AS risk_level,
  greatest(72.0::DOUBLE * (1 - if_score), 1.0) AS hours FROM scores)"""


@query("K3, S10", f"""
WITH {_SCORED}
SELECT event_id, p AS failure_probability, risk_level, round(hours, 6) AS time_to_failure_hours FROM scored
""")
def failure_risk(t: Tables) -> DataFrame:
    """Risk and hours to failure from given probabilities."""
    given = t.scores.select("event_id", F.col("if_score").alias("failure_probability"))
    return rounded(failures.with_risk(given), "time_to_failure_hours")


@query("K4", f"""
WITH {_SCORED}
SELECT event_id, risk_level, CASE risk_level WHEN 'CRITICAL' THEN 'Immediate intervention required'
    WHEN 'HIGH' THEN 'Schedule maintenance within 24 hours' ELSE 'Monitor and plan maintenance' END AS action,
  CASE risk_level
    WHEN 'CRITICAL' THEN printf('System failure predicted within %.1f hours with %.1f%% confidence', hours, p * 100)
    WHEN 'HIGH' THEN printf('Potential failure in %.1f hours with %.1f%% confidence', hours, p * 100)
    ELSE printf('Moderate risk detected with %.1f%% failure probability', p * 100) END AS description,
  CASE risk_level WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 4 ELSE 3 END AS actions
FROM scored WHERE risk_level <> 'LOW'
""")
def failure_recommendations(t: Tables) -> DataFrame:
    given = t.scores.select("event_id", F.col("if_score").alias("failure_probability"))
    advice = failures.recommendations(failures.with_risk(given))
    return advice.select("event_id", "risk_level", "action", "description", F.size("suggested_actions").alias("actions"))


@query("K1", f"""
WITH {_SCORED}, sized AS (SELECT risk_level, count(*) AS n, count(DISTINCT event_id) AS ids FROM scored GROUP BY ALL)
SELECT risk_level, n AS rows, (2 * n + 5) // 10 AS test_rows, ids AS distinct_events FROM sized
""")
def stratified_parts(t: Tables) -> DataFrame:
    """Rows of each class that test, exactly a fifth, rounded."""
    given = failures.with_risk(t.scores.select("event_id", F.col("if_score").alias("failure_probability")))
    parts = failures.stratified_split(given, "risk_level", ["event_id"])
    return parts.groupBy("risk_level").agg(
        F.count("*").alias("rows"), F.count_if(F.col("part") == "test").alias("test_rows"),
        F.countDistinct("event_id").alias("distinct_events"),
    )


def _labelled(t: Tables) -> DataFrame:
    full = cleaning.filled(t.written("wide"), METRICS, by=("host",))
    return materialised(intervals.label_failures(full, t.alert_times), "labelled")


@query("K2, C10")
def balanced_classes(t: Tables) -> DataFrame:
    """Rows per class and host, before and after oversampling."""
    labelled = _labelled(t)
    after = neighbours.oversampled(labelled, METRICS, "failure")
    return after.groupBy("host", "failure").agg(
        F.count("*").alias("rows"), F.count("clock").alias("original_rows"),
        F.round(F.avg("vm_memory_utilization"), 6).alias("mean_memory"),
    )


@query("K1, K5, F5")
def failure_model_importances(t: Tables) -> DataFrame:
    """Forest trained on the feature pipeline's output; features by importance."""
    model = failure_prediction.train(t.written("wide"), METRICS, t.alert_times)
    return rounded(model.importances, "importance")


@query("K1, K3, K5, D14")
def failure_predictions(t: Tables) -> DataFrame:
    """Forest with class weights, scored over the whole history."""
    wide = t.written("wide")
    model = failure_prediction.train(wide, METRICS, t.alert_times, balance="weights")
    return rounded(failure_prediction.predict(wide, model), "failure_probability", "time_to_failure_hours")
