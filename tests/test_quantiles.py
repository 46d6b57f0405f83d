import numpy as np

from pyspark.sql import functions as F

from hostpulse.operators import baseline, cleaning, intervals
from hostpulse.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 0.95, 0.98, 1.0]


def test_equals_numpy_with_a_hot_key_and_ties(spark):
    rows = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        F.when(F.col("id") % 5 == 0, F.lit(3.25)).otherwise(F.pmod(F.xxhash64("id"), F.lit(10_000_019)) / 1000).alias("v"),
    )
    got = {r["key"]: r["quantiles"] for r in exact_quantiles(rows, ["key"], "v", SHARES).collect()}
    data = rows.toPandas()
    assert set(got) == set(data["key"])
    for key, part in data.groupby("key"):
        np.testing.assert_allclose(got[key], np.quantile(part["v"], SHARES), rtol=1e-12)


def test_small_groups_and_nulls(spark):
    rows = [("a", float(x)) for x in (5, 1)] + [("b", 2.0), ("c", None)] + [("d", float(x)) for x in range(11)] + [("d", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    got = {r["key"]: r["quantiles"] for r in exact_quantiles(df, ["key"], "v", SHARES).collect()}
    for key, values in (("a", [1, 5]), ("b", [2]), ("d", range(11))):
        np.testing.assert_allclose(got[key], np.quantile(list(values), SHARES))
    assert "c" not in got


def test_without_keys(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert exact_quantiles(df, [], "v", [0.5, 0.9]).first()[0] == [500.0, 900.0]


def test_baseline_of_odd_series(spark):
    rows = [("h", "constant", i, 4.0) for i in range(20)] + [("h", "gone", i, None) for i in range(20)]
    rows += [("h", "single", 0, 1.0)] + [("h", "ramp", i, float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "host string, measurement string, clock bigint, value double")
    got = {r["measurement"]: r for r in baseline.fit_baseline(df).collect()}
    assert set(got) == {"constant", "single", "ramp"}
    assert got["constant"]["std"] == got["constant"]["mad"] == got["constant"]["iqr"] == got["single"]["std"] == 1e-8
    assert (got["ramp"]["median"], got["ramp"]["mad"], got["ramp"]["iqr"]) == (50.0, 25.0, 50.0)


def test_preparation_drops_what_it_must(spark):
    inf = float("inf")
    rows = [("h", "good", i, float(i % 9)) for i in range(30)] + [("h", "constant", i, 4.0) for i in range(30)]
    rows += [("h", "sparse", i, 1.0 * i if i < 3 else None) for i in range(30)]
    rows += [("h", "wild", i, inf if i == 3 else float(i)) for i in range(30)]
    rows += [("h", "short", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "host string, measurement string, clock bigint, value double")
    out = cleaning.prepare_training(df).toPandas()
    assert set(out["measurement"]) == {"good", "wild"}
    assert np.isfinite(out["value"]).all() and len(out) == 60


def test_empty_input(spark):
    empty = spark.createDataFrame([], "host string, measurement string, clock bigint, value double")
    assert baseline.fit_baseline(empty).count() == 0
    assert cleaning.clean(empty).count() == 0


def test_interval_labels_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    samples = [(h, int(c)) for h in "ab" for c in rng.integers(0, 60_000, 500)]
    alerts = [(h, int(c)) for h in "a" for c in rng.integers(0, 60_000, 12)]
    got = intervals.mark_near(
        spark.createDataFrame(samples, "host string, clock bigint"),
        spark.createDataFrame(alerts, "host string, alert_clock bigint"), 700, 300, "near",
    ).collect()
    assert len(got) == len(samples)
    for host, clock, near in got:
        assert near == int(any(h == host and a - 700 <= clock <= a + 300 for h, a in alerts))


def test_brackets_of_large_keys_do_not_overlap_wrongly(spark):
    """Close probabilities and heavy ties make brackets meet; negative values need stand-ins below them."""
    rows = spark.range(400_000).select(
        F.lit("k").alias("key"),
        F.when(F.col("id") % 3 == 0, F.lit(-7.5)).otherwise((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) - 900_000) / 10.0).alias("v"),
    )
    shares = [0.5, 0.50001, 0.25, 0.9999, 0.00001]
    got = exact_quantiles(rows, ["key"], "v", shares).first()["quantiles"]
    np.testing.assert_allclose(got, np.quantile(rows.toPandas()["v"], shares), rtol=1e-12)
