"""Alert, trigger and catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import intervals, relations
from hostpulse.registered import query
from hostpulse.sources.tables import AS_OF, Tables

WEEK = 7 * 86400

#: Each trigger with its host, once per function that watches an item of the host.
_WATCHED_SQL = """
watched AS (
  SELECT u.triggerid, o.hostid, o.host, o.name, o.status, count(*) AS functions
  FROM functions u, items m, hosts o
  WHERE m.itemid = u.itemid AND o.hostid = m.hostid
  GROUP BY ALL),
raised AS (
  SELECT p.*, r.triggerid, r.description, r.expression, r.priority, r.status AS state
  FROM problems p, triggers r WHERE r.triggerid = p.objectid AND p.source = 0)
"""

# Names of the result columns, by where they come from.
_ALERT_COLUMNS = {
    "n": {"alertid": "alertid", "clock": "alert_time", "sendto": "sendto", "subject": "subject", "message": "message",
          "status": "alert_status"},
    "r": {"eventid": "eventid", "clock": "event_time", "value": "event_value", "severity": "severity",
          "acknowledged": "acknowledged", "triggerid": "triggerid", "description": "trigger_description",
          "priority": "trigger_priority", "state": "trigger_status"},
    "w": {"hostid": "hostid", "host": "hostname", "name": "host_display_name", "status": "host_status"},
}
_EVENT_COLUMNS = {
    "r": {"eventid": "eventid", "clock": "event_time", "value": "event_value", "severity": "severity",
          "acknowledged": "acknowledged", "triggerid": "triggerid", "description": "trigger_description",
          "expression": "trigger_expression", "priority": "priority"},
    "w": {"host": "hostname"},
}


def _columns(names: dict[str, dict[str, str]]) -> str:
    return ", ".join(f"{table}.{c} AS {out}" for table, own in names.items() for c, out in own.items())


#: A row of the joins comes once per function, so rows are repeated by the number of functions.
_ALERT_SQL = f"""
WITH {_WATCHED_SQL}
SELECT {_columns(_ALERT_COLUMNS)}
FROM alerts n, raised r, watched w, range(w.functions) AS times(k)
WHERE n.clock >= 1706659200 - 604800 AND r.eventid = n.eventid AND w.triggerid = r.triggerid
"""


def _alerts(t: Tables, **kw: object) -> DataFrame:
    week = t.since(AS_OF - WEEK - 30)  # an alert follows its event by half a minute
    return relations.alert_history(
        week.alerts, week.problems, t.triggers, t.functions, t.items, t.hosts, since=AS_OF - WEEK, **kw
    )


@query("C2", _ALERT_SQL)
def alert_history(t: Tables) -> DataFrame:
    return _alerts(t)


@query("C2", _ALERT_SQL.replace("SELECT n.", "SELECT DISTINCT n."))
def alert_history_without_repeats(t: Tables) -> DataFrame:
    return _alerts(t, distinct_alerts=True)


def _event_sql(least: int | None = None) -> str:
    rows = f"r.clock >= 1706659200 - 604800{'' if least is None else f' AND r.severity >= {least}'}"
    return f"""
WITH {_WATCHED_SQL},
frequency AS (
  SELECT r.triggerid, sum(w.functions) AS times FROM raised r, watched w WHERE w.triggerid = r.triggerid AND {rows} GROUP BY ALL)
SELECT {_columns(_EVENT_COLUMNS)}, q.times::BIGINT AS trigger_frequency
FROM raised r, watched w, frequency q, range(w.functions) AS copies(k)
WHERE w.triggerid = r.triggerid AND q.triggerid = r.triggerid AND {rows}
"""


def _events(t: Tables, **kw: object) -> DataFrame:
    return relations.trigger_events(t.since(AS_OF - WEEK).problems, t.triggers, t.functions, t.items, t.hosts, since=AS_OF - WEEK, **kw)


@query("C3, E1", _event_sql())
def trigger_events(t: Tables) -> DataFrame:
    return _events(t)


@query("B7", _event_sql(3))
def severe_trigger_events(t: Tables) -> DataFrame:
    return _events(t, min_severity=3)


@query("C4", """
SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM alert_times a WHERE a.host = s.host
         AND s.clock BETWEEN a.alert_clock - 1800 AND a.alert_clock + 1800) THEN 1 ELSE 0 END AS is_anomaly
FROM samples s
""")
def anomaly_labels(t: Tables) -> DataFrame:
    return intervals.label_anomalies(t.samples, t.alert_times)


@query("C5", """
SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM alert_times a WHERE a.host = s.host
         AND s.clock BETWEEN a.alert_clock - 7200 AND a.alert_clock) THEN 1 ELSE 0 END AS failure
FROM samples s
""")
def failure_labels(t: Tables) -> DataFrame:
    return intervals.label_failures(t.samples, t.alert_times)


@query("C6, G2", """
WITH labels_by_hour AS (
  SELECT DISTINCT host, clock, CASE WHEN EXISTS (SELECT 1 FROM alert_times a WHERE a.host = h.host
           AND h.clock BETWEEN a.alert_clock - 7200 AND a.alert_clock) THEN 1 ELSE 0 END AS failure
  FROM hourly h WHERE EXISTS (SELECT 1 FROM alert_times a WHERE a.host = h.host
           AND h.clock BETWEEN a.alert_clock - 86400 AND a.alert_clock + 86400))
SELECT w.*, l.failure FROM wide w JOIN labels_by_hour l ON w.host = l.host AND w.clock = l.clock
""")
def features_with_labels(t: Tables) -> DataFrame:
    """Feature rows and labels known at the same time only. Labels are known within a day of an alert."""
    times = t.hourly.select("host", "clock").distinct()
    near = intervals.mark_near(times, t.alert_times, 86400, 86400, "_known").where("_known = 1").drop("_known")
    return t.wide.join(intervals.label_failures(near, t.alert_times), ["host", "clock"])


@query("D18", """
SELECT count(*) AS alert_count, max(clock) AS latest_alert FROM alerts WHERE clock >= 1706659200 - 604800
""")
def recent_alert_summary(t: Tables) -> DataFrame:
    return relations.alert_summary(t.since(AS_OF - WEEK - 30).alerts, AS_OF - WEEK)


@query("D19", """
SELECT o.host, CASE WHEN o.status = 0 THEN 1 ELSE 0 END AS active,
       count(CASE WHEN h.clock > 1706659200 - 3600 THEN 1 END) AS recent_rows
FROM hosts o LEFT JOIN items i ON i.hostid = o.hostid LEFT JOIN history h ON h.itemid = i.itemid
GROUP BY o.host, o.status
""")
def history_presence(t: Tables) -> DataFrame:
    return relations.history_presence(t.since(AS_OF - 3600).history, t.items, t.hosts, AS_OF - 3600)


@query("F4", "SELECT hostid, host, name, status FROM hosts WHERE status IN (0, 1) ORDER BY host LIMIT 20")
def known_hosts(t: Tables) -> DataFrame:
    return relations.known_hosts(t.hosts)
