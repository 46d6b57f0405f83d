"""Data that used to vanish or flatten without a word."""

import json

import pytest
from pyspark.sql import functions as F

from hostpulse.operators import cleaning, windows
from hostpulse.sources import ingest, registry, samples
from hostpulse.streaming import pipelines


@pytest.mark.parametrize("method, most", [("standard", 1.7), ("minmax", 1.0), ("robust", 1.0)])
def test_tiny_series_keep_their_shape(spark, method, most):
    rows = [("h", i, i * 1e-11, 5.0, 0.1 + 0.2) for i in range(101)]
    wide = spark.createDataFrame(rows, "host string, clock long, ramp double, flat double, third double")
    columns = ["ramp", "flat", "third"]
    out = cleaning.scaled(wide, columns, cleaning.fit_scaling(wide, columns, method)).agg(
        F.max("ramp"), F.max(F.abs("flat")), F.max(F.abs("third"))).first()
    assert out[0] == pytest.approx(most, rel=0.02) and out[1] == 0 and out[2] < 1e-15


def test_deviation_of_equal_values_is_zero(spark):
    rows = [("h", "m", i, 0.1 + 1e6) for i in range(40)]
    df = spark.createDataFrame(rows, "host string, measurement string, clock long, value double")
    got = windows.rolling_by_rows(df, rows=[5]).agg(F.max("value_rolling_std_5")).first()[0]
    assert got == 0.0


def test_stream_of_a_table_of_several_files(spark, tmp_path):
    spark.range(1000).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream = pipelines.table_stream(spark, str(tmp_path), "events", max_files=1)
    pipelines.finished(pipelines.write_files(stream, str(tmp_path / "out"), str(tmp_path / "mark")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def _routed(spark, **fields):
    event = {"itemid": 1, "clock": 10, "value": 2.5, "item_key": "a", "hostname": "h", "units": "B", "table_type": "history"} | fields
    line = json.dumps({k: v for k, v in event.items() if v is not None})
    return ingest.route_events(ingest.parse_events(spark.createDataFrame([(line,)], "raw string"))).first()


@pytest.mark.parametrize("fields, route, tag", [
    ({}, "stored", None), ({"value": "abc"}, "invalid", "unparsable_fields"), ({"clock": "x"}, "invalid", "unparsable_fields"),
    ({"value": "NaN"}, "invalid", "unparsable_fields"), ({"value": None}, "invalid", "missing_required_fields"),
    ({"value": "text", "table_type": "history_text"}, "dropped", None),
])
def test_unparsable_numbers_are_quarantined(spark, fields, route, tag):
    row = _routed(spark, **fields)
    assert (row.route, row.tag) == (route, tag)


def test_versions(spark, tmp_path):
    table = spark.createDataFrame([(m, 1.0) for m in "abc"], "metric string, mean double")
    for version in ("9.0_20240101_000000", "9.0_20240101_000000", "10.0_20240201_000000"):
        registry.save_version(table.withColumn("mean", F.lit(len(version) * 1.0)), str(tmp_path), "m", version)
    latest = registry.load_version(spark, str(tmp_path), "m")
    assert latest.count() == 3 and latest.first().version == "10.0_20240201_000000"
    assert registry.load_version(spark, str(tmp_path), "m", "9.0_20240101_000000").count() == 3
    known = spark.createDataFrame([("x", "9.0_20240101_000000", 1), ("x", "10.0_20240201_000000", 2)], "model_name string, version string, training_samples long")
    assert registry.latest_versions(known).first().training_samples == 2


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    points = spark.createDataFrame([("m", "h", "1", 5.0, c) for c in (0, 86400, 90000)], "measurement string, host string, item_id string, value double, clock long")
    for batch in ("1", "2", "2"):
        ingest.write_store(points, str(tmp_path / "s"), batch)
    store = samples.read_relation(spark, str(tmp_path / "s"))
    assert store.count() == 6
    assert samples.scan_history(store, 100000, hours=10, measurements=["m"]).count() == 4


@pytest.mark.parametrize("name", ["metric_history_scan", "relational_scan", "incremental_export", "alert_history", "trigger_events",
                                  "recent_alert_summary", "history_presence"])
def test_time_bounds_reach_the_scan(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line and "events.parquet" in line]
    assert scans and all("GreaterThanOrEqual(ts," in line for line in scans)
