"""Trained models, checked by what must hold whatever numbers they learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.operators import cleaning, ensemble, neighbours
from hostpulse.plans import datasets, detection, failure_prediction, forecasting, stores
from hostpulse.registered import query
from hostpulse.registered.cleaning import KEPT, PROFILES
from hostpulse.registered.failures import _labelled
from hostpulse.registered.neighbours import _detector
from hostpulse.session import materialised, shared_dir
from hostpulse.sources import registry
from hostpulse.sources.tables import AS_OF, METRICS, Tables

VERSION = "1.0_20240130_200000"
_ADDITIVE, _ARIMA = fixed.MIN_FORECAST_ROWS["profiled"]


@query("J2, J3, J4, H14, H15", f"""
WITH {PROFILES}, {KEPT},
known AS (SELECT host, measurement, count(*) AS n, max(clock) AS last FROM kept WHERE value IS NOT NULL GROUP BY ALL)
SELECT host, measurement AS metric, model, 24 AS steps, last + 3600 AS first_ds, last + 24 * 3600 AS last_ds, 1 AS step_from,
  true AS ordered
FROM known, (VALUES ('additive', {_ADDITIVE}), ('arima', {_ARIMA})) m(model, least) WHERE n >= least
""")
def forecast_frames(t: Tables) -> DataFrame:
    """Which series each model forecasts, for which hours, and whether the bounds enclose the value."""
    rows = forecasting.forecast(forecasting.train(t.written("hourly")), periods=24)
    inside = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    stepped = F.max(F.col("ds") - F.col("step") * 3600) == F.min(F.col("ds") - F.col("step") * 3600)
    return rows.groupBy("host", "metric", "model").agg(
        F.count("*").cast("int").alias("steps"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"),
        F.min("step").cast("int").alias("step_from"), (F.every(inside) & stepped).alias("ordered"),
    )


@query("J5", f"""
WITH sizes AS (SELECT host, measurement AS metric, count(*) * 8 // 10 AS n FROM hourly GROUP BY ALL)
SELECT host, metric, model, n AS training_samples, '24h' AS prediction_horizon, '1.0_20240131_000000' AS version
FROM sizes, (VALUES ('additive'), ('arima')) m(model) WHERE n > 0
""")
def trained_forecaster_counts(t: Tables) -> DataFrame:
    """What every series was trained on, for both models."""
    return forecasting.evaluated(t.written("hourly"), AS_OF).select(
        "host", "metric", "model", F.col("training_samples").cast("long").alias("training_samples"), "prediction_horizon", "version"
    )


@query("A9", f"""
WITH {PROFILES}, {KEPT},
known AS (SELECT host, measurement, count(*) AS n FROM kept WHERE value IS NOT NULL GROUP BY ALL)
SELECT host, measurement AS metric, CASE WHEN n >= {_ARIMA} THEN 48 ELSE 24 END AS rows, 0 AS differing FROM known
WHERE n >= {min(_ADDITIVE, _ARIMA)} AND measurement IN ('{METRICS[0]}', '{METRICS[1]}')
""")
def forecasters_round_trip(t: Tables) -> DataFrame:
    """Forecasters saved whole, loaded for two metrics, and their forecasts against those of the unsaved ones."""
    root = shared_dir(t.spark, "models")
    fitted = forecasting.train(t.written("hourly"))
    stores.save_forecasters(t.spark, fitted, root, VERSION, 0)
    loaded = forecasting.forecast(stores.load_forecasters(t.spark, root, metrics=METRICS[:2]))
    plain = forecasting.forecast(fitted).select("host", "metric", "model", "step", F.col("yhat").alias("before"))
    both = loaded.join(plain, ["host", "metric", "model", "step"])
    return both.groupBy("host", "metric").agg(
        F.count("*").cast("int").alias("rows"), F.count_if(F.abs(F.col("yhat") - F.col("before")) > 1e-9).cast("int").alias("differing")
    )


_TRAINED = "trained AS (SELECT host, count(*) AS rows FROM wide GROUP BY host HAVING count(*) >= 10)"


@query("A7, A8, I10, D11, D12, H3", f"WITH {_TRAINED} SELECT host, rows, 0 AS differing FROM trained")
def detector_round_trip(t: Tables) -> DataFrame:
    """A detector saved whole and loaded scores as before."""
    root = shared_dir(t.spark, "models")
    training, model = _detector(t)
    stores.save_detector(t.spark, model, root, VERSION, training.count())
    before = detection.detector_flags(training, model).select("host", "clock", F.col("confidence_score").alias("before"))
    after = detection.detector_flags(training, stores.load_detector(t.spark, root))
    return after.join(before, ["host", "clock"]).groupBy("host").agg(
        F.count("*").alias("rows"), F.count_if(F.abs(F.col("confidence_score") - F.col("before")) > 1e-9).cast("int").alias("differing")
    )


@query("I5, I6, I7, I8, I13", f"WITH {_TRAINED} SELECT host, rows, true AS voted, true AS ranked, true AS flagged FROM trained")
def detector_votes(t: Tables) -> DataFrame:
    """Votes, confidence and flags as their rules say, per host.

    Flags: a row is flagged where its score lies below the tenth of the scores of its host.
    """
    training, model = _detector(t)
    flags = detection.detector_flags(training, model)
    total = F.col("if_flag") + F.col("lof_flag") + F.col("stat_flag")
    sound = (F.col("confidence_score") >= 0) & (F.col("confidence_score") <= 1)
    tenth = flags.groupBy("host").agg(F.percentile("if_score", 0.1).alias("if_tenth"), F.percentile("lof_score", 0.1).alias("lof_tenth"))
    own = flags.join(tenth, "host")
    right = ((F.col("if_score") < F.col("if_tenth") - 1e-12).cast("int") <= F.col("if_flag")) & (
        F.col("if_flag") <= (F.col("if_score") < F.col("if_tenth") + 1e-12).cast("int")
    )
    return own.groupBy("host").agg(
        F.count("*").alias("rows"), F.every((total >= 2).cast("int") == F.col("is_anomaly")).alias("voted"),
        F.every(sound).alias("ranked"), F.every(right).alias("flagged"),
    )


@query("I11, E12", f"WITH {_TRAINED} SELECT host, 4 AS shares, true AS best FROM trained")
def contamination_choices(t: Tables) -> DataFrame:
    """Four shares are tried per host, and the best is one that no other beats."""
    training = materialised(detection.training_frame(t.written("wide"), METRICS), "training")
    scores = materialised(detection.contamination_scores(training, METRICS), "contamination")
    best = detection.best_contamination(scores).withColumnRenamed("contamination", "chosen")
    joined = scores.join(best, "host")
    chosen = F.max(F.when(F.col("contamination") == F.col("chosen"), F.col("mean_decision")))
    return joined.groupBy("host").agg(F.count("*").cast("int").alias("shares"), (chosen >= F.max("mean_decision")).alias("best"))


_LABELLED = """
labelled AS (SELECT host, clock, CASE WHEN EXISTS (SELECT 1 FROM alert_times a WHERE a.host = w.host
  AND w.clock BETWEEN a.alert_clock - 7200 AND a.alert_clock) THEN 1 ELSE 0 END AS failure FROM wide w)"""


@query("K2, C10", f"""
WITH {_LABELLED},
own AS (SELECT host, sum(failure) AS ones, count(*) AS n, least(sum(failure), count(*) - sum(failure)) AS small FROM labelled GROUP BY host),
parts AS (SELECT host, failure, count(*) AS original_rows FROM labelled GROUP BY ALL)
SELECT p.host, p.failure, CASE WHEN small > 1 THEN n - small ELSE original_rows END AS rows, original_rows
FROM parts p JOIN own o ON p.host = o.host
""")
def balanced_class_counts(t: Tables) -> DataFrame:
    """Rows per host and class after balancing: both classes as many as the larger."""
    after = neighbours.oversampled(_labelled(t), METRICS, "failure")
    return after.groupBy("host", "failure").agg(
        F.count("*").cast("decimal(38,0)").alias("rows"), F.count("clock").alias("original_rows")
    )


_FEATURES = datasets.pipeline_features(METRICS)


@query("K1, K5, F5, A7, A8", f"""
SELECT 'rows' AS fact, count(*)::BIGINT AS value FROM wide UNION ALL SELECT 'differing', 0 UNION ALL SELECT 'unsound', 0
UNION ALL SELECT 'features', {len(_FEATURES)} UNION ALL SELECT 'unknown', 0 UNION ALL SELECT 'sum', 1
""")
def failure_model_facts(t: Tables) -> DataFrame:
    """A failure model saved whole, loaded, and run: equal predictions, sound risks, importances of all features."""
    root, wide = shared_dir(t.spark, "models"), t.written("wide")
    model = failure_prediction.train(wide, METRICS, t.alert_times, balance="weights")
    stores.save_failure_model(t.spark, model, root, VERSION, wide.count())
    loaded = stores.load_failure_model(t.spark, root)
    before = failure_prediction.predict(wide, model).select("host", "clock", F.col("failure_probability").alias("before"))
    after = failure_prediction.predict(wide, loaded).join(before, ["host", "clock"])
    p = F.col("failure_probability")
    level = F.when(p >= 0.8, "CRITICAL").when(p >= 0.6, "HIGH").when(p >= 0.4, "MEDIUM").otherwise("LOW")
    sound = (p >= 0) & (p <= 1) & (F.col("risk_level") == level) & (F.abs(F.col("time_to_failure_hours") - F.greatest(72 * (1 - p), F.lit(1.0))) < 1e-9)
    facts = after.agg(
        F.count("*").alias("rows"), F.count_if(F.abs(p - F.col("before")) > 1e-9).alias("differing"), F.count_if(~sound).alias("unsound")
    ).unpivot([], ["rows", "differing", "unsound"], "fact", "value")
    about = loaded.importances.agg(
        F.count_distinct("feature").alias("features"), F.count_if(~F.col("feature").isin(_FEATURES) | (F.col("importance") < 0)).alias("unknown"),
        F.round(F.sum("importance"), 6).cast("long").alias("sum"),
    ).unpivot([], ["features", "unknown", "sum"], "fact", "value")
    return facts.unionByName(about)


@query("L5, A7", """
SELECT 'detector' AS model_name, '10.0_20240130_230000' AS version, count(*)::BIGINT AS training_samples, 1.0::DOUBLE AS hours_since_training,
  true AS ready_for_detection, false AS needs_retraining, true AS retrain_skipped FROM hourly
""")
def stored_model_status(t: Tables) -> DataFrame:
    """Status from the descriptions of models that were really stored; the newest by time, not by text."""
    root = shared_dir(t.spark, "models")
    training = materialised(cleaning.filled(t.written("wide"), METRICS, by=("host",)), "training")
    model = detection.fit_detector(training, METRICS)
    rows = t.hourly.count()
    for version, n in (("9.0_20240130_200000", 1), ("10.0_20240130_230000", rows)):
        stores.save_detector(t.spark, model, root, version, n)
    return registry.registry_status(stores.catalogue(t.spark, root, ["detector"]), AS_OF)


@query("D13", "SELECT count(*)::BIGINT AS rows, true AS agrees FROM wide")
def silhouette_closed_form(t: Tables) -> DataFrame:
    """The separation score against its closed form: mean squared distances to both groups from sums alone."""
    flags = detection.accuracy_flags(t.written("wide"), METRICS).withColumnRenamed("outlier", "is_anomaly")
    flags = materialised(flags.select("is_anomaly", *[F.col(c).cast("double").alias(c) for c in METRICS]), "flags")
    square = sum((F.col(c) * F.col(c) for c in METRICS[1:]), F.col(METRICS[0]) * F.col(METRICS[0]))
    groups = flags.groupBy("is_anomaly").agg(
        F.count("*").alias("n"), F.sum(square).alias("squares"), *[F.sum(c).alias(f"sum_{c}") for c in METRICS]
    )
    one = groups.agg(F.collect_list(F.struct(*groups.columns)).alias("groups"))  # two groups

    def mean_distance(g):
        dot = sum((F.col(c) * g[f"sum_{c}"] for c in METRICS[1:]), F.col(METRICS[0]) * g[f"sum_{METRICS[0]}"])
        return square + g["squares"] / g["n"] - 2 * dot / g["n"]

    own = F.filter("groups", lambda g: g["is_anomaly"] == F.col("is_anomaly"))[0]
    other = F.filter("groups", lambda g: g["is_anomaly"] != F.col("is_anomaly"))[0]
    pair = flags.select("*", F.lit(1).alias("_one")).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one")
    a = F.try_divide(mean_distance(own) * own["n"], own["n"] - 1)
    b = mean_distance(other)
    score = F.when(own["n"] == 1, 0.0).otherwise((b - a) / F.greatest(a, b))
    closed = pair.agg(F.avg(score).alias("closed"))
    library = ensemble.silhouette(flags, METRICS)
    both = library.withColumn("_one", F.lit(1)).join(closed.withColumn("_one", F.lit(1)), "_one")  # a row each
    return both.select("rows", (F.abs(F.col("closed") - F.col("silhouette_score")) < 1e-6).alias("agrees"))
