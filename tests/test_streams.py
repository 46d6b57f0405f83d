"""Streams over several micro-batches equal the batch result."""

import pytest

from pyspark.sql import functions as F

from hostpulse.operators import indicators
from hostpulse.sources import ingest
from hostpulse.streaming import pipelines

POINTS = "host string, item_id string, clock bigint, value double"


def _files(spark, tmp_path, batches):
    """One parquet file per micro-batch, read in order."""
    import time

    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, POINTS).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # file order follows modification time
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(path)


def test_replays_collapse_and_late_samples_drop(spark, tmp_path):
    stream = _files(
        spark, tmp_path,
        [[("h", "1", 1000, 1.0), ("h", "1", 1060, 2.0)], [("h", "1", 1060, 2.0), ("h", "1", 9000, 3.0)],
         [("h", "1", 9100, 4.0)], [("h", "1", 1100, 9.0)]],
    )  # lateness is judged by the mark the batch before last has set
    out = str(tmp_path / "out")
    pipelines.finished(pipelines.write_files(pipelines.deduplicated(stream), out, str(tmp_path / "ck")))
    assert sorted(r["clock"] for r in spark.read.parquet(out).collect()) == [1000, 1060, 9000, 9100]


def test_alert_state_carries_over_batches(spark, tmp_path):
    values = [1, 9, 9, 9, 9, 1, 9, 9, 9, 9, 9, 1]
    rows = [("h", "1", i * 100, float(v)) for i, v in enumerate(values)] + [("g", "1", i * 100, 9.0) for i in range(12)]
    batches = [[r for r in rows if lo <= r[2] < lo + 300] for lo in range(0, 1200, 300)]
    stream = _files(spark, tmp_path, batches).select("host", "clock", "value")
    out = str(tmp_path / "out")
    write = pipelines.alert_states(spark, str(tmp_path / "runs"), out, limit=5, hold=300)
    pipelines.finished(pipelines.write_batches(stream, write, str(tmp_path / "ck")))
    whole = indicators.alert_state(spark.createDataFrame(rows, POINTS), 5, 300)
    columns = ["host", "clock", "state"]
    got = sorted(map(tuple, spark.read.parquet(out).select(*columns).collect()))
    assert got == sorted(map(tuple, whole.select(*columns).collect()))
    assert {s for _, _, s in got} == {"ok", "pending", "firing"}


def test_routing_of_broken_and_partial_lines(spark, tmp_path):
    lines = [
        '{"itemid":1,"clock":10,"value":2.5,"item_key":"a.b[c]","hostname":"my host","units":"","table_type":"history"}',
        '{"itemid":1,"clock":10,"value":2.5,"item_key":"a","hostname":"h","units":"B/s","table_type":"history_uint"}',
        '{"itemid":1,"clock":10,"item_key":"a","hostname":"h","table_type":"history"}',
        '{"itemid":1,"clock":10,"value":1,"hostname":"h","table_type":"trends"}',
        "{broken",
    ]
    df = ingest.route_events(ingest.parse_events(spark.createDataFrame([(x,) for x in lines], "raw string")))
    rows = [tuple(r) for r in df.select("route", "measurement", "host", "unit", "value").collect()]
    assert rows[0] == ("stored", "a_b_c", "my_host", "none", 2.5)
    assert rows[1] == ("stored", "a", "h", "B_s", 2.0)
    assert [r[0] for r in rows] == ["stored", "stored", "invalid", "dropped", "broken"]
    assert rows[3][1] == "unknown_metric" and rows[4][1] == "json_parse_error"
    text = [r["line"] for r in ingest.line_protocol(ingest.stored_points(df)).collect()]
    assert text[0] == "a_b_c,host=my_host,item_id=1,data_type=numeric,unit=none value=2.5 10"


def test_a_failed_batch_is_not_lost(spark, tmp_path):
    stream = _files(spark, tmp_path, [[("h", "1", 1000, 1.0)], [("h", "1", 2000, 2.0)]])
    out, checkpoint, failed = str(tmp_path / "out"), str(tmp_path / "ck"), []

    def write(batch, batch_id):
        if batch_id == 1 and not failed:
            failed.append(1)
            raise RuntimeError("executor lost")
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with pytest.raises(Exception):
        pipelines.finished(pipelines.write_batches(stream, write, checkpoint))
    pipelines.finished(pipelines.write_batches(stream, write, checkpoint))
    assert spark.read.parquet(out).agg(F.sum("value")).first()[0] == 3.0
