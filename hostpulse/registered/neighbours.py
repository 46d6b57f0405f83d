"""Neighbour, forest and ensemble queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions.numeric import clean_map
from hostpulse.operators import cleaning, ensemble, isolation, neighbours, quality, separation
from hostpulse.plans import detection
from hostpulse.registered import query, rounded
from hostpulse.registered.cleaning import FILLED_WIDE
from hostpulse.session import materialised
from hostpulse.sources.tables import AS_OF, METRICS, Tables


def _full(t: Tables) -> DataFrame:
    return materialised(cleaning.filled(t.written("wide"), METRICS, by=("host",)), "filled")


_DISTANCE = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in METRICS) + ")"


@query("C10", f"""
WITH {FILLED_WIDE},
full_rows AS (SELECT host, clock, {', '.join(f'coalesce({c}, 0) AS {c}' for c in METRICS)} FROM filled),
pairs AS (SELECT a.host, a.clock, {_DISTANCE} AS distance FROM full_rows a JOIN full_rows b
  ON a.host = b.host AND a.clock <> b.clock),
ranked AS (SELECT *, row_number() OVER (PARTITION BY host, clock ORDER BY distance) AS rank FROM pairs)
SELECT host, clock, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM ranked WHERE rank <= 5
""")
def nearest_neighbours(t: Tables) -> DataFrame:
    found = neighbours.k_nearest(_full(t), METRICS, k=5)
    return rounded(found.select("host", "clock", "rank", "distance"), "distance")


@query("I6", f"""
WITH {FILLED_WIDE},
full_rows AS (SELECT host, clock, {', '.join(f'coalesce({c}, 0) AS {c}' for c in METRICS)} FROM filled),
pairs AS (SELECT a.host, a.clock, b.clock AS other, [{', '.join(f'b.{c}' for c in METRICS)}] AS point,
  {_DISTANCE} AS distance FROM full_rows a JOIN full_rows b ON a.host = b.host AND a.clock <> b.clock),
edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY host, clock ORDER BY distance, point) AS rn FROM pairs)
  WHERE rn <= 20),
reach AS (SELECT host, clock, max(distance) AS k_distance FROM edges GROUP BY ALL),
density AS (SELECT e.host, e.clock, 1 / (avg(greatest(distance, k_distance)) + 1e-10) AS density
  FROM edges e JOIN reach r ON e.host = r.host AND e.other = r.clock GROUP BY ALL)
SELECT e.host, e.clock, round(avg(o.density) / any_value(s.density), 6) AS lof
FROM edges e JOIN density o ON e.host = o.host AND e.other = o.clock
JOIN density s ON e.host = s.host AND e.clock = s.clock GROUP BY e.host, e.clock
""")
def local_outlier_factor(t: Tables) -> DataFrame:
    full = _full(t)
    model = neighbours.fit_lof(full, METRICS, k=20)
    rows = neighbours.as_points(full, METRICS).join(model.select("host", "point", "lof"), ["host", "point"])
    return rounded(rows.select("host", "clock", "lof"), "lof")


_SHARED = " + ".join(f"CASE WHEN a.{c} IS NOT NULL AND b.{c} IS NOT NULL THEN 1 ELSE 0 END" for c in METRICS)
_SQUARE = " + ".join(f"coalesce((a.{c} - b.{c}) * (a.{c} - b.{c}), 0)" for c in METRICS)
_FILLS = ", ".join(
    f"""fill_{i} AS (SELECT host, clock, favg(v) AS v FROM (SELECT host, clock, v{i} AS v, row_number() OVER (
  PARTITION BY host, clock ORDER BY square / shared, other) AS rn FROM pairs WHERE q{i} IS NULL AND v{i} IS NOT NULL AND shared > 0)
  WHERE rn <= 5 GROUP BY ALL)"""
    for i, _ in enumerate(METRICS)
)


KNN_SQL = f"""
pairs AS (SELECT a.host, a.clock, b.clock AS other, {_SHARED} AS shared, {_SQUARE} AS square,
  {', '.join(f'a.{c} AS q{i}, b.{c} AS v{i}' for i, c in enumerate(METRICS))}
  FROM wide a JOIN wide b ON a.host = b.host), {_FILLS},
means AS (SELECT host, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(METRICS))} FROM wide GROUP BY host)"""
KNN_FILLED_SQL = f"""
SELECT w.host, w.clock, {', '.join(f'coalesce({c}, fill_{i}.v, m{i}) AS {c}' for i, c in enumerate(METRICS))}
FROM wide w JOIN means ON w.host = means.host
{' '.join(f'LEFT JOIN fill_{i} ON w.host = fill_{i}.host AND w.clock = fill_{i}.clock' for i, _ in enumerate(METRICS))}"""


@query("H9", f"""
WITH {KNN_SQL}
SELECT host, clock, {', '.join(f'round({c} + 1e-9, 6) AS {c}' for c in METRICS)} FROM ({KNN_FILLED_SQL})
""")
def neighbour_imputed(t: Tables) -> DataFrame:
    return rounded(neighbours.knn_imputed(t.written("wide"), METRICS), *METRICS, nudge=1e-9)


@query("I5")
def isolation_forest(t: Tables) -> DataFrame:
    """Forest score and flag per host and hour."""
    flags = detection.accuracy_flags(t.written("wide"), METRICS)
    return rounded(flags.select("host", "clock", "if_score", "outlier"), "if_score")


@query("D8")
def data_quality_accuracy(t: Tables) -> DataFrame:
    """Quality with accuracy from the forest: the share of rows it takes for normal."""
    flags = detection.accuracy_flags(t.written("wide"), METRICS).select("host", "clock", "outlier")
    return quality.frame_quality(t.written("wide").join(flags, ["host", "clock"]), [*METRICS, "host"], outlier="outlier")


def _detector(t: Tables) -> tuple[DataFrame, detection.Detector]:
    training = materialised(detection.training_frame(t.written("wide"), METRICS), "training")
    return training, detection.fit_detector(training, METRICS)


@query("I10, D11, D12, H3")
def trained_detector_report(t: Tables) -> DataFrame:
    """Prepare, fit forest, LOF and baseline, and evaluate on the training rows."""
    training, model = _detector(t)
    return detection.evaluate(detection.detector_flags(training, model))


@query("I13, I5, I6, I7, I8, I9, B9, S10, F3")
def detected_anomalies(t: Tables) -> DataFrame:
    """All three detectors trained on the whole history and run over it."""
    _, model = _detector(t)
    records = detection.detect(cleaning.filled(t.written("wide"), METRICS, by=("host",)), model)
    return records.select(
        "host", "clock", "confidence_score", "severity", F.to_json(clean_map(F.col("affected_metrics"))).alias("affected_metrics")
    )


@query("D13")
def detection_silhouette(t: Tables) -> DataFrame:
    """Separation of the forest's normal and outlying rows."""
    flags = detection.accuracy_flags(t.written("wide"), METRICS).withColumnRenamed("outlier", "is_anomaly")
    return rounded(ensemble.silhouette(flags, METRICS), "silhouette_score")


@query("D13", f"""
WITH {FILLED_WIDE},
busy_full_rows AS (SELECT host, clock, {', '.join(f'coalesce({c}, 0) AS {c}' for c in METRICS)}, CASE WHEN {METRICS[0]} > 20 THEN 1 ELSE 0 END AS high FROM filled),
busy_sizes AS (SELECT host, count(*) AS n, sum(high) AS ones FROM busy_full_rows GROUP BY host),
busy_sums AS (SELECT a.host, a.clock, any_value(a.high) AS high, sum({_DISTANCE}) FILTER (a.high = b.high) AS own, sum({_DISTANCE}) FILTER (a.high <> b.high) AS other
  FROM busy_full_rows a JOIN busy_full_rows b ON a.host = b.host GROUP BY a.host, a.clock),
busy_means AS (SELECT s.*, CASE WHEN high = 1 THEN ones ELSE n - ones END AS k, n FROM busy_sums s JOIN busy_sizes USING (host) WHERE n > 10 AND ones BETWEEN 1 AND n - 1),
busy_scores AS (SELECT host, CASE WHEN k = 1 OR greatest(own, other) = 0 THEN 0 ELSE (other / (n - k) - own / (k - 1)) / greatest(other / (n - k), own / (k - 1)) END AS s FROM busy_means)
SELECT z.host, CAST(z.n AS BIGINT) AS rows, round(m.score, 6) AS silhouette_score
FROM busy_sizes z LEFT JOIN (SELECT host, avg(s) AS score FROM busy_scores GROUP BY host) m ON z.host = m.host
""")
def separation_of_busy_rows(t: Tables) -> DataFrame:
    """How far the hours of a busy processor lie from the others, per host, by true distances."""
    full = _full(t)
    busy = full.withColumn("high", F.when(F.col(METRICS[0]) > 20, 1).otherwise(0))
    return rounded(separation.silhouette(busy, METRICS, "high"), "silhouette_score")


@query("I11, E12")
def contamination_search(t: Tables) -> DataFrame:
    training = materialised(detection.training_frame(t.written("wide"), METRICS), "training")
    scores = materialised(detection.contamination_scores(training, METRICS), "contamination")
    best = detection.best_contamination(scores).withColumnRenamed("contamination", "best")
    return rounded(scores.join(best, "host"), "mean_decision")


@query("I12", """
WITH c AS (SELECT host, count(DISTINCT clock) FILTER (clock >= 1706659200 - 24 * 3600) AS a,
  count(DISTINCT clock) FILTER (clock >= 1706659200 - 48 * 3600) AS b,
  count(DISTINCT clock) FILTER (clock >= 1706659200 - 3600) AS c
  FROM samples WHERE clock >= 1706659200 - 48 * 3600 GROUP BY host)
SELECT host, CAST(CASE WHEN a >= 35 THEN 24 WHEN b >= 35 THEN 48 WHEN c >= 35 THEN 1 END AS INTEGER) AS hours_back FROM c
""")
def training_fallback(t: Tables) -> DataFrame:
    return detection.fallback_range(t.samples, AS_OF, hours=24, minimum=35)
