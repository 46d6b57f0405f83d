"""Streaming queries: each streams a whole table and is compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import baseline
from hostpulse.registered import query, rounded
from hostpulse.registered.anomalies import BASELINE, fitted
from hostpulse.registered.ingest import _PARSED_SQL
from hostpulse.session import shared_dir
from hostpulse.sources import ingest, lines, samples, upserts
from hostpulse.sources.tables import AS_OF, Tables, base_samples
from hostpulse.streaming import alerts, pipelines


def _lines(t: Tables) -> DataFrame:
    """The raw payloads as a stream of text files."""
    path = shared_dir(t.spark, "payloads")
    t.raw.select("raw").write.mode("overwrite").text(path)
    return pipelines.json_lines(t.spark, path)


def _points(t: Tables) -> DataFrame:
    """The samples as a stream of the events table."""
    return base_samples(pipelines.table_stream(t.spark, t.folder, "events"))


def _run_to_files(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    out = shared_dir(t.spark, name)
    pipelines.finished(pipelines.write_files(stream, out, shared_dir(t.spark, f"{name}-checkpoint")))
    return t.spark.read.schema(stream.schema).parquet(out)


@query("M1", _PARSED_SQL + """
SELECT measurement, hostname AS host, itemid AS item_id, clock,
       CASE table_type WHEN 'history' THEN value ELSE trunc(value) END AS value FROM routed WHERE route = 'stored'
""")
def streamed_ingest(t: Tables) -> DataFrame:
    """JSON files to stored points."""
    stored = ingest.stored_points(pipelines.routed(_lines(t)))
    return _run_to_files(t, stored, "ingested").select("measurement", "host", "item_id", "clock", "value")


@query("M3, B1, B2", _PARSED_SQL + """
SELECT CASE WHEN route = 'stored' THEN 'stored' ELSE 'quarantine' END AS part, measurement, count(*) AS events
FROM routed GROUP BY ALL
""")
def streamed_routes(t: Tables) -> DataFrame:
    """Each micro-batch split into stored points and quarantine."""
    good, bad = shared_dir(t.spark, "stored"), shared_dir(t.spark, "quarantine")
    pipelines.finished(
        pipelines.write_batches(
            pipelines.routed(_lines(t)), pipelines.split_routes(good, bad), shared_dir(t.spark, "routes-checkpoint")
        )
    )
    parts = [
        t.spark.read.parquet(path).select(F.lit(name).alias("part"), "measurement")
        for name, path in (("stored", good), ("quarantine", bad))
    ]
    return parts[0].unionByName(parts[1]).groupBy("part", "measurement").agg(F.count("*").alias("events"))


@query("M3, A1, A6", _PARSED_SQL + """
SELECT measurement, CAST(to_timestamp(clock) AS DATE)::VARCHAR AS date, count(*) AS points,
       round(sum(CASE table_type WHEN 'history' THEN value ELSE trunc(value) END), 6) AS total
FROM routed WHERE route = 'stored' AND clock >= 1706659200 - 168 * 3600 AND clock < 1706659200 GROUP BY ALL
""")
def streamed_store_scan(t: Tables) -> DataFrame:
    """Points streamed into the dated store, then scanned for one week with folder pruning."""
    good, bad = shared_dir(t.spark, "store"), shared_dir(t.spark, "quarantine")
    write = pipelines.split_routes(good, bad)
    pipelines.finished(pipelines.write_batches(pipelines.routed(_lines(t)), write, shared_dir(t.spark, "store-checkpoint")))
    week = samples.scan_history(samples.read_relation(t.spark, good), AS_OF, hours=168)
    return week.groupBy("measurement", F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("points"), F.round(F.sum("value"), 6).alias("total")
    )


@query("A1, A6, M1", _PARSED_SQL + """
SELECT name AS measurement, regexp_replace(hostname, '[^a-zA-Z0-9_-]', '_', 'g') AS host, itemid AS item_id, clock,
       CASE table_type WHEN 'history' THEN value ELSE trunc(value) END AS value FROM routed WHERE route = 'stored'
""")
def streamed_line_source(t: Tables) -> DataFrame:
    """Dated lines read as a stream and stored as points."""
    path = shared_dir(t.spark, "dated-lines")
    lines.write_dated(ingest.stored_points(ingest.route_events(ingest.parse_events(t.raw))), path)
    points = lines.points(lines.stream(t.spark, path)).select("measurement", "host", "item_id", "clock", "value")
    return _run_to_files(t, points, "line-points")


@query("M2", "SELECT DISTINCT host, itemid, clock, 1 AS copies FROM base")
def streamed_dedupe(t: Tables) -> DataFrame:
    """Every sample delivered twice; one row per item and second remains."""
    once = _points(t).select("host", "itemid", "clock")
    twice = once.withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_again")
    kept = pipelines.deduplicated(twice, keys=("host", "itemid", "clock"))
    return _run_to_files(t, kept, "deduplicated").groupBy("host", "itemid", "clock").agg(
        F.count("*").cast("int").alias("copies")
    )


@query("M2, A6, M1", "SELECT host, measurement, clock, arg_max(value, event_id) AS value FROM base GROUP BY ALL")
def streamed_upserts(t: Tables) -> DataFrame:
    """A first delivery with other values, then the stream of the true ones: the store holds the last."""
    path = shared_dir(t.spark, "upserts")
    columns = ["event_id", "host", "measurement", "clock", "value"]
    upserts.upsert(t.base.select(*columns).withColumn("value", F.col("value") - 1), path, "event_id", writer="export", batch=0)
    pipelines.finished(pipelines.write_batches(
        _points(t).select(*columns), pipelines.upserts(path, "event_id"), shared_dir(t.spark, "upserts-checkpoint")
    ))
    return upserts.read(t.spark, path).select("host", "measurement", "clock", "value")


@query("M4", """
SELECT host, measurement, window_start, window_start + 3600 AS window_end, round(avg(value), 6) AS value
FROM (SELECT *, clock - clock % 3600 AS window_start FROM base)
WHERE window_start + 3600 <= (SELECT max(clock) - 600 FROM base) GROUP BY host, measurement, window_start
""")
def streamed_window_mean(t: Tables) -> DataFrame:
    """Hourly means of the windows the watermark has closed."""
    means = pipelines.windowed(_points(t).select("host", "measurement", "clock", "value"))
    return rounded(_run_to_files(t, means, "windowed"), "value")


@query("M5", f"""
WITH {BASELINE}
SELECT b.event_id, CASE WHEN abs((value - mean) / std) > 3 THEN 1 ELSE 0 END AS z_score,
  CASE WHEN abs(0.6745 * (value - median) / mad) > 3.5 THEN 1 ELSE 0 END AS modified_z_score,
  CASE WHEN value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr THEN 1 ELSE 0 END AS iqr_score
FROM base b JOIN baseline s ON b.host = s.host AND b.measurement = s.measurement
""")
def streamed_scoring(t: Tables) -> DataFrame:
    """Raw samples scored as they arrive against the stored hourly baseline."""
    points = _points(t).select("event_id", "host", "measurement", "value")
    return _run_to_files(t, pipelines.scored(points, fitted(t)), "scored").select(
        "event_id", "z_score", "modified_z_score", "iqr_score"
    )


_STATES_SQL = """
WITH evaluations AS (SELECT host, slot AS clock, max(value) AS value FROM (SELECT *, clock - clock % 300 AS slot FROM base)
  WHERE slot + 300 <= (SELECT max(clock) - 600 FROM base) GROUP BY host, slot),
marked AS (SELECT *, value > 20 AS high,
  max(CASE WHEN value <= 20 THEN clock END) OVER (PARTITION BY host ORDER BY clock) AS ok_clock FROM evaluations),
runs AS (SELECT *, min(clock) FILTER (high) OVER (PARTITION BY host, ok_clock) AS start FROM marked)
SELECT host, clock, value, CASE WHEN NOT high THEN 'ok' WHEN clock - start >= 3600 THEN 'firing' ELSE 'pending' END AS state
FROM runs
"""


@query("M6", _STATES_SQL)
def streamed_alert_states(t: Tables) -> DataFrame:
    """Five-minute maxima from the stream, judged batch by batch."""
    highest = pipelines.windowed(
        _points(t).select("host", "clock", "value"), "5m", "max", by=("host",)
    ).select("host", F.col("window_start").alias("clock"), "value")
    carried, out = shared_dir(t.spark, "open-runs"), shared_dir(t.spark, "states")
    write = pipelines.alert_states(t.spark, carried, out, limit=20, hold=3600)
    pipelines.finished(pipelines.write_batches(highest, write, shared_dir(t.spark, "states-checkpoint")))
    return t.spark.read.parquet(out).select("host", "clock", "value", "state")


@query("M6", _STATES_SQL)
def streamed_held_rule(t: Tables) -> DataFrame:
    """The same evaluations judged by one stateful operator, whose runs live in the state store."""
    highest = pipelines.windowed(
        _points(t).select("host", "clock", "value"), "5m", "max", by=("host",)
    ).select("host", F.col("window_start").alias("clock"), "value")
    stored = shared_dir(t.spark, "evaluations")
    pipelines.finished(pipelines.write_files(highest, stored, shared_dir(t.spark, "evaluations-checkpoint")))
    evaluations = t.spark.readStream.schema("host string, clock bigint, value double").parquet(stored)
    with alerts.state_store(t.spark):
        states = _run_to_files(t, alerts.held_rule(evaluations, limit=20, hold=3600), "held-rule")
    return states.where("state <> 'silent'").select("host", "clock", "value", "state")
