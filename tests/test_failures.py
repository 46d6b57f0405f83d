"""Failure models of fleets in which all rows are of one class."""

import pytest
from pyspark.sql import functions as F

from hostpulse.operators import failures


@pytest.mark.parametrize("label, risk", [(0, "LOW"), (1, "CRITICAL")])
def test_one_class(spark, label, risk):
    rows = spark.range(60).select((F.col("id") / 7).alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.lit(label).alias("failure"))
    weighted = failures.class_weights(rows, "failure")
    model = failures.fit_classifier(weighted, ["a", "b"], "failure", "class_weight", trees=3)
    got = failures.failure_scores(model, rows).select("failure_probability", "failure_prediction", "risk_level").distinct().collect()
    assert [tuple(r) for r in got] == [(float(label), label, risk)]
    importances = failures.feature_importances(model, rows, ["a", "b"]).collect()
    assert [tuple(r) for r in importances] == [("a", 0.0), ("b", 0.0)]  # nothing was split, so nothing counts
