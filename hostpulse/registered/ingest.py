"""Scans, export, parsing, routing and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import text
from hostpulse.registered import query
from hostpulse.session import shared_dir
from hostpulse.sources import export, ingest, lines, samples
from hostpulse.sources.tables import AS_OF, METRICS, SAMPLE_TYPE, Tables

WEEK = 7 * 86400


@query("A1", """
SELECT host, measurement, clock, value FROM samples
WHERE clock >= 1706659200 - 168 * 3600 AND clock < 1706659200
  AND measurement IN ('vm_memory_utilization', 'system_cpu_util_user', 'proc_num', 'proc_num_run', 'system_uptime',
    'system_cpu_load_all_avg1', 'system_cpu_load_all_avg5', 'system_cpu_load_all_avg15', 'system_cpu_intr',
    'agent_ping', 'system_cpu_util_system', 'net_if_out_eth0', 'net_if_out_eth0_errors')
""")
def metric_history_scan(t: Tables) -> DataFrame:
    return samples.scan_history(t.since(AS_OF - WEEK).samples, AS_OF, hours=168).select("host", "measurement", "clock", "value")


@query("A2", """
SELECT eventid, objectid, clock, severity FROM problems WHERE clock >= 1706659200 - 604800 AND source = 0
""")
def relational_scan(t: Tables) -> DataFrame:
    return samples.scan_since(t.since(AS_OF - WEEK).problems, "clock", AS_OF - WEEK, source=0).select(
        "eventid", "objectid", "clock", "severity"
    )


_EXPORT_SQL = """
WITH joined AS (
  SELECT h.itemid, h.clock, CAST(h.value AS DOUBLE) AS value, h.ns, h.event_id, i.key_, i.name, i.units, o.host,
         'history' AS table_type
  FROM history h JOIN items i ON h.itemid = i.itemid JOIN hosts o ON i.hostid = o.hostid
  WHERE h.clock > 1706659200 - 86400 AND i.status = 0 AND o.status = 0
  UNION ALL
  SELECT h.itemid, h.clock, CAST(h.value AS DOUBLE), h.ns, h.event_id, i.key_, i.name, i.units, o.host, 'history_uint'
  FROM history_uint h JOIN items i ON h.itemid = i.itemid JOIN hosts o ON i.hostid = o.hostid
  WHERE h.clock > 1706659200 - 86400 AND i.status = 0 AND o.status = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY host, table_type ORDER BY clock DESC, itemid DESC, event_id DESC) AS rn
  FROM joined),
exported AS (
  SELECT itemid, clock, value, ns, trim(regexp_replace(replace(key_, '"', ''), ' +', ' ', 'g')) AS item_key,
         trim(regexp_replace(replace(name, '"', ''), ' +', ' ', 'g')) AS item_name,
         coalesce(nullif(replace(units, '"', ''), ''), 'none') AS units,
         replace(replace(host, '"', ''), ' ', '_') AS hostname, table_type
  FROM ranked WHERE rn <= CASE table_type WHEN 'history' THEN 5 ELSE 3 END)
"""


def _export(t: Tables) -> DataFrame:
    day = t.since(AS_OF - 86400)
    return export.export_batch(day.history, day.history_uint, t.items, t.hosts, AS_OF, look_back=86400)


@query("A3, B6, C1, S3, S4", _EXPORT_SQL + "SELECT * FROM exported")
def incremental_export(t: Tables) -> DataFrame:
    return _export(t)


@query("A5", _EXPORT_SQL + """
SELECT itemid, clock, SAMPLE AS type, item_key, hostname, table_type, value, 1706659200 AS export_timestamp
FROM (SELECT *, 'host-metrics' AS SAMPLE FROM exported)
""")
def json_event_payloads(t: Tables) -> DataFrame:
    """Payloads, read back field by field."""
    events = export.json_events(_export(t), SAMPLE_TYPE, AS_OF)
    fields = F.from_json(
        "payload",
        "type string, item_key string, hostname string, table_type string, value double, export_timestamp int",
    )
    return events.select("itemid", "clock", fields.alias("e")).select("itemid", "clock", "e.*")


@query("C1", """
SELECT h.itemid, i.key_, o.host AS hostname, count(*) AS samples, min(h.clock) AS first_clock,
       max(h.clock) AS last_clock
FROM history h JOIN items i ON h.itemid = i.itemid JOIN hosts o ON i.hostid = o.hostid
WHERE i.status = 0 AND o.status = 0 GROUP BY ALL
""")
def history_with_metadata(t: Tables) -> DataFrame:
    return (
        export.with_metadata(t.history, t.items, t.hosts)
        .groupBy("itemid", "key_", "hostname")
        .agg(
            F.count("*").alias("samples"),
            F.min("clock").alias("first_clock"),
            F.max("clock").alias("last_clock"),
        )
    )


_PARSED_SQL = """
WITH parsed AS (
  SELECT event_id, try_cast(raw AS JSON) IS NULL AS broken,
         CASE WHEN try_cast(raw AS JSON) IS NOT NULL THEN raw END AS j FROM raw),
fields AS (
  SELECT event_id, broken, j ->> '$.itemid' AS itemid, j ->> '$.clock' AS told_clock, j ->> '$.value' AS told_value,
         try_cast(j ->> '$.clock' AS BIGINT) AS clock, try_cast(j ->> '$.value' AS DOUBLE) AS value, j ->> '$.item_key' AS item_key, j ->> '$.units' AS units,
         j ->> '$.hostname' AS hostname, j ->> '$.table_type' AS table_type FROM parsed),
named AS (
  SELECT *, (itemid IS NULL OR told_clock IS NULL OR told_value IS NULL) AS missing,
         (clock IS NULL OR coalesce(table_type IN ('history', 'history_uint'), false) AND NOT coalesce(isfinite(value), false)) AS unparsable,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(item_key, '[^a-zA-Z0-9_]', '_', 'g'),
           '__+', '_', 'g'), '^_+', '', 'g'), '_+$', '', 'g') AS name FROM fields),
routed AS (
  SELECT *, CASE WHEN broken THEN 'broken' WHEN missing OR unparsable THEN 'invalid'
                 WHEN table_type IN ('history', 'history_uint') THEN 'stored' ELSE 'dropped' END AS route,
         CASE WHEN broken THEN 'json_parse_error' WHEN missing OR unparsable THEN 'invalid_data' ELSE name END AS measurement
  FROM named)
"""


@query("A4, B1", _PARSED_SQL + """
SELECT event_id, route, measurement, CASE WHEN broken THEN 'json_parsing_failed' END AS error_type,
       CASE WHEN broken THEN NULL WHEN missing THEN 'missing_required_fields' WHEN unparsable THEN 'unparsable_fields' END AS tag
FROM routed
""")
def json_event_ingest(t: Tables) -> DataFrame:
    return ingest.route_events(ingest.parse_events(t.raw)).select(
        "event_id", "route", "measurement", "error_type", "tag"
    )


@query("B2", _PARSED_SQL + "SELECT route, count(*) AS events FROM routed GROUP BY route")
def event_routes(t: Tables) -> DataFrame:
    return ingest.route_events(ingest.parse_events(t.raw)).groupBy("route").agg(F.count("*").alias("events"))


@query("B3", _PARSED_SQL + """
SELECT event_id, CASE table_type WHEN 'history' THEN value WHEN 'history_uint' THEN trunc(value) END AS value,
       CASE WHEN route = 'stored' THEN 'numeric' END AS data_type,
       CASE WHEN table_type = 'history' THEN 'float' WHEN table_type = 'history_uint' THEN 'integer' END
         AS value_category
FROM routed WHERE route IN ('stored', 'dropped')
""")
def typed_event_values(t: Tables) -> DataFrame:
    routed = ingest.route_events(ingest.parse_events(t.raw))
    return routed.where(F.col("route").isin(ingest.STORED, ingest.OTHER)).select(
        "event_id", "value", "data_type", "value_category"
    )


@query("A6, S1, S2", _PARSED_SQL + """
SELECT concat(measurement, ',host=', regexp_replace(hostname, '[^a-zA-Z0-9_-]', '_', 'g'), ',item_id=', itemid,
              ',data_type=numeric,unit=', regexp_replace(units, '[^a-zA-Z0-9_%]', '_', 'g')) AS series, clock,
       CASE table_type WHEN 'history' THEN value ELSE trunc(value) END AS value
FROM routed WHERE route = 'stored'
""")
def line_protocol_sink(t: Tables) -> DataFrame:
    """Lines written as text and read back, split into series, value and time."""
    path = shared_dir(t.spark, "lines")
    ingest.write_lines(ingest.stored_points(ingest.route_events(ingest.parse_events(t.raw))), path)
    parts = F.split("value", " ")
    return t.spark.read.text(path).select(
        parts[0].alias("series"),
        parts[2].cast("bigint").alias("clock"),
        F.substring_index(parts[1], "=", -1).cast("double").alias("value"),
    )


@query("A1, A6", _PARSED_SQL + """
SELECT name AS measurement, regexp_replace(hostname, '[^a-zA-Z0-9_-]', '_', 'g') AS host, itemid AS item_id, 'numeric' AS data_type,
       regexp_replace(units, '[^a-zA-Z0-9_%]', '_', 'g') AS unit, clock,
       CASE table_type WHEN 'history' THEN value ELSE trunc(value) END AS value
FROM routed WHERE route = 'stored' AND clock >= 1706659200 - 168 * 3600 AND clock < 1706659200
""")
def line_protocol_source(t: Tables) -> DataFrame:
    """Points written as dated lines and read back for one week; the bounds prune day folders."""
    path = shared_dir(t.spark, "dated-lines")
    lines.write_dated(ingest.stored_points(ingest.route_events(ingest.parse_events(t.raw))), path)
    week = lines.read(t.spark, path, AS_OF - 168 * 3600, AS_OF)
    return lines.points(week).select("measurement", "host", "item_id", "data_type", "unit", "clock", "value")


@query("A6, A1", _PARSED_SQL + """
SELECT measurement, CAST(to_timestamp(clock) AS DATE)::VARCHAR AS date, count(*) AS points,
       round(sum(CASE table_type WHEN 'history' THEN value ELSE trunc(value) END), 6) AS total
FROM routed WHERE route = 'stored' AND clock >= 1706659200 - 168 * 3600 GROUP BY ALL
""")
def partitioned_store_sink(t: Tables) -> DataFrame:
    """Points written to the dated store, then scanned for one week with folder pruning."""
    path = shared_dir(t.spark, "store")
    ingest.write_store(ingest.stored_points(ingest.route_events(ingest.parse_events(t.raw))), path)
    week = samples.scan_history(samples.read_relation(t.spark, path), AS_OF, hours=168)
    return week.groupBy("measurement", F.col("date").cast("string").alias("date")).agg(
        F.count("*").alias("points"), F.round(F.sum("value"), 6).alias("total")
    )


@query("S1, S2", """
SELECT DISTINCT i.itemid,
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(key_, '[^a-zA-Z0-9_]', '_', 'g'),
         '__+', '_', 'g'), '^_+', '', 'g'), '_+$', '', 'g') AS measurement,
       regexp_replace(h.name, '[^a-zA-Z0-9_-]', '_', 'g') AS host,
       CASE WHEN units = '' THEN 'none' ELSE regexp_replace(units, '[^a-zA-Z0-9_%]', '_', 'g') END AS unit
FROM items i JOIN hosts h ON i.hostid = h.hostid
""")
def clean_names(t: Tables) -> DataFrame:
    hosts = t.hosts.select("hostid", F.col("name").alias("host_name"))
    return t.items.join(hosts, "hostid").select(
        "itemid",
        text.measurement_name(F.col("key_")).alias("measurement"),
        text.host_tag(F.col("host_name")).alias("host"),
        text.unit_tag(F.col("units")).alias("unit"),
    )


@query("S3, S4", """
WITH dirty AS (
  SELECT event_id, concat(' "', key_, '"', chr(10), '  ', replace(props, ':', chr(9)), ' ') AS dirty_key,
         concat('Host "', user_id % 10, '" a') AS dirty_host,
         CASE event_type WHEN 'click' THEN '%' WHEN 'view' THEN '"%"' ELSE '' END AS dirty_unit
  FROM (SELECT b.event_id, b.key_, b.event_type, e.props, e.user_id
        FROM base b JOIN events e ON b.event_id = e.event_id))
SELECT event_id,
       trim(regexp_replace(replace(replace(replace(replace(dirty_key, '"', ''), chr(10), ' '), chr(13), ' '),
         chr(9), ' '), ' +', ' ', 'g')) AS clean_key,
       replace(replace(dirty_host, '"', ''), ' ', '_') AS clean_host,
       coalesce(nullif(replace(dirty_unit, '"', ''), ''), 'none') AS clean_unit
FROM dirty
""")
def clean_exported_text(t: Tables) -> DataFrame:
    props = t.table("events").select("event_id", "props", "user_id")
    dirty = t.base.select("event_id", "key_", "event_type").join(props, "event_id")
    key = F.concat(
        F.lit(' "'), "key_", F.lit('"\n  '), F.regexp_replace("props", ":", "\t"), F.lit(" ")
    )
    unit = F.when(F.col("event_type") == "click", "%").when(F.col("event_type") == "view", '"%"').otherwise("")
    return dirty.select(
        "event_id",
        text.squeeze(text.plain_text(key)).alias("clean_key"),
        text.plain_host(F.concat(F.lit('Host "'), F.col("user_id") % 10, F.lit('" a'))).alias("clean_host"),
        text.plain_unit(unit).alias("clean_unit"),
    )


@query("B4, F2", """
SELECT host, measurement, clock, value FROM samples ORDER BY clock, host, measurement
""")
def tidy_store_points(t: Tables) -> DataFrame:
    """Store output with its bookkeeping columns, tidied and sorted by time."""
    points = t.samples.select(
        F.lit("_result").alias("result"),
        F.lit(0).alias("table"),
        F.lit(AS_OF - WEEK).alias("_start"),
        F.lit(AS_OF).alias("_stop"),
        "host",
        F.col("measurement").alias("_measurement"),
        F.col("clock").alias("_time"),
        F.col("value").cast("string").alias("_value"),
    )
    return samples.tidy_points(points).orderBy("clock", "host", "measurement")


@query("B5", """
SELECT eventid, clock AS event_epoch, strftime(to_timestamp(clock) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS event_time,
       CAST(severity AS DOUBLE) AS severity FROM problems
""")
def tidy_trigger_events(t: Tables) -> DataFrame:
    events = t.problems.select(
        "eventid", F.col("clock").alias("event_epoch"), F.col("clock").alias("event_time"),
        F.col("severity").cast("string").alias("severity"),
    )
    return samples.tidy_relation(events).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss"))


@query("G1", """
SELECT host, clock, """ + ", ".join(f"CASE WHEN measurement = '{m}' THEN value END AS {m}" for m in METRICS) + """
FROM hourly
""")
def union_of_frames(t: Tables) -> DataFrame:
    frames = [
        t.hourly.where(F.col("measurement") == m).select("host", "clock", F.col("value").alias(m))
        for m in METRICS
    ]
    return samples.union_frames(frames)


@query("F1", _EXPORT_SQL.replace("1706659200 - 86400", "0").split("exported AS")[0].rstrip().rstrip(",") + """
SELECT host AS hostname, table_type, itemid, clock, value FROM ranked
WHERE rn <= CASE table_type WHEN 'history' THEN 5 ELSE 3 END
""")
def newest_samples(t: Tables) -> DataFrame:
    parts = [
        export.newest(export.with_metadata(source, t.items, t.hosts), n).select(
            "hostname", F.lit(kind).alias("table_type"), "itemid", "clock", F.col("value").cast("double").alias("value")
        )
        for source, kind, n in ((t.history, "history", 5), (t.history_uint, "history_uint", 3))
    ]
    return parts[0].unionByName(parts[1])
