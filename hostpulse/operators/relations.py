"""Alert history, trigger events and catalogue reads over the relational tables.

Joins carry no forced broadcast: the planner broadcasts sides it measures as small and
shuffles the others, where skewed keys are split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _trigger_hosts(triggers: DataFrame, functions: DataFrame, items: DataFrame, hosts: DataFrame) -> DataFrame:
    """Trigger to host, one row per trigger function: a trigger with two functions appears twice."""
    return (
        functions.select("triggerid", "itemid")
        .join(triggers, "triggerid")
        .join(items.select("itemid", "hostid"), "itemid")
        .join(hosts, "hostid")
    )


def alert_history(
    alerts: DataFrame,
    events: DataFrame,
    triggers: DataFrame,
    functions: DataFrame,
    items: DataFrame,
    hosts: DataFrame,
    since: int,
    host: str | None = None,
    distinct_alerts: bool = False,
) -> DataFrame:
    """Alerts since a time with their event, trigger and host, newest first.

    Rows repeat per trigger function, as an inner join gives them; ``distinct_alerts``
    keeps one per alert and host.
    """
    named_hosts = hosts.select(
        "hostid",
        F.col("host").alias("hostname"),
        F.col("name").alias("host_display_name"),
        F.col("status").alias("host_status"),
    )
    if host is not None:
        named_hosts = named_hosts.where(F.col("hostname") == host)
    named_triggers = triggers.select(
        "triggerid",
        F.col("description").alias("trigger_description"),
        F.col("priority").alias("trigger_priority"),
        F.col("status").alias("trigger_status"),
    )
    origin = _trigger_hosts(named_triggers, functions, items, named_hosts)
    recent = alerts.where(F.col("clock") >= since).select(
        "alertid", F.col("clock").alias("alert_time"), "sendto", "subject", "message",
        F.col("status").alias("alert_status"), "eventid",
    )
    from_triggers = events.where(F.col("source") == 0).select(
        "eventid", F.col("clock").alias("event_time"), F.col("value").alias("event_value"), "severity",
        "acknowledged", F.col("objectid").alias("triggerid"),
    )
    joined = recent.join(from_triggers, "eventid").join(origin, "triggerid")
    if distinct_alerts:
        joined = joined.dropDuplicates(["alertid", "hostid"])
    return joined.select(
        "alertid", "alert_time", "sendto", "subject", "message", "alert_status", "eventid", "event_time",
        "event_value", "severity", "acknowledged", "triggerid", "trigger_description", "trigger_priority",
        "trigger_status", "hostid", "hostname", "host_display_name", "host_status",
    ).orderBy(F.col("alert_time").desc(), "alertid")


def trigger_events(
    events: DataFrame,
    triggers: DataFrame,
    functions: DataFrame,
    items: DataFrame,
    hosts: DataFrame,
    since: int,
    host: str | None = None,
    min_severity: int | None = None,
) -> DataFrame:
    """Trigger events since a time with how often each trigger fired, newest first.

    The count per trigger is an aggregate joined back, not a window, so that a trigger
    with a large share of the events does not land in one task.
    """
    recent = events.where((F.col("clock") >= since) & (F.col("source") == 0))
    if min_severity is not None:
        recent = recent.where(F.col("severity") >= min_severity)
    named_hosts = hosts.select("hostid", F.col("host").alias("hostname"))
    if host is not None:
        named_hosts = named_hosts.where(F.col("hostname") == host)
    named_triggers = triggers.select(
        "triggerid", F.col("description").alias("trigger_description"),
        F.col("expression").alias("trigger_expression"), "priority",
    )
    joined = recent.select(
        "eventid", F.col("clock").alias("event_time"), F.col("value").alias("event_value"), "severity",
        "acknowledged", F.col("objectid").alias("triggerid"),
    ).join(_trigger_hosts(named_triggers, functions, items, named_hosts), "triggerid")
    frequency = joined.groupBy("triggerid").agg(F.count("*").alias("trigger_frequency"))
    return joined.join(frequency, "triggerid").select(
        "eventid", "event_time", "event_value", "severity", "acknowledged", "triggerid", "trigger_description",
        "trigger_expression", "priority", "hostname", "trigger_frequency",
    ).orderBy(F.col("event_time").desc(), "eventid")


def alert_summary(alerts: DataFrame, since: int) -> DataFrame:
    return alerts.where(F.col("clock") >= since).agg(
        F.count("*").alias("alert_count"), F.max("clock").alias("latest_alert")
    )


def history_presence(history: DataFrame, items: DataFrame, hosts: DataFrame, since: int) -> DataFrame:
    """Per host: is it active, and how many history rows it has since a time."""
    recent = (
        history.where(F.col("clock") > since)
        .groupBy("itemid")
        .agg(F.count("*").alias("n"))
        .join(items.select("itemid", "hostid"), "itemid")
        .groupBy("hostid")
        .agg(F.sum("n").alias("recent_rows"))
    )
    return hosts.join(recent, "hostid", "left").select(
        "host",
        (F.col("status") == 0).cast("int").alias("active"),
        F.coalesce("recent_rows", F.lit(0)).alias("recent_rows"),
    )


def known_hosts(hosts: DataFrame, n: int = 20) -> DataFrame:
    """First hosts by name, active or not."""
    return hosts.where(F.col("status").isin(0, 1)).select("hostid", "host", "name", "status").orderBy("host").limit(n)
