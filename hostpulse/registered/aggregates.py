"""Window aggregates and dashboard reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import aggregates
from hostpulse.registered import query, r, rounded
from hostpulse.sources.tables import AS_OF, METRICS, Tables


def _window_sql(aggregate: str, name: str, window: str, seconds: int) -> str:
    return f"""
SELECT host, measurement, clock - clock % {seconds} AS window_start, clock - clock % {seconds} + {seconds} AS window_end,
       round({aggregate}, 6) AS value, '{name}' AS aggregation_type, '{window}' AS window_size
FROM samples GROUP BY ALL
"""


def _window(t: Tables, window: str, aggregation: str) -> DataFrame:
    return rounded(aggregates.window_aggregate(t.samples, window, aggregation), "value")


@query("D1", _window_sql("avg(value)", "mean", "1h", 3600))
def window_mean(t: Tables) -> DataFrame:
    return _window(t, "1h", "mean")


@query("D1", _window_sql("max(value)", "max", "5m", 300))
def window_max(t: Tables) -> DataFrame:
    return _window(t, "5m", "max")


@query("D1", _window_sql("min(value)", "min", "1d", 86400))
def window_min(t: Tables) -> DataFrame:
    return _window(t, "1d", "min")


@query("D1", _window_sql("arg_max(value, clock)", "last", "6h", 21600))
def window_last(t: Tables) -> DataFrame:
    return _window(t, "6h", "last")


@query("D2", "SELECT * FROM wide")
def metrics_pivot(t: Tables) -> DataFrame:
    return aggregates.to_wide(t.hourly, METRICS)


@query("D3", """
SELECT host, measurement, max(clock) AS clock, arg_max(value, clock) AS value FROM samples GROUP BY ALL
""")
def last_values(t: Tables) -> DataFrame:
    return aggregates.last_values(t.samples)


@query("D4", """
SELECT host, measurement, arg_max(value, clock) AS last, max(value) AS max, round(avg(value), 6) AS mean
FROM samples GROUP BY ALL
""")
def series_legend(t: Tables) -> DataFrame:
    return rounded(aggregates.legend(t.samples), "mean")


@query("D5", """
SELECT host, clock - clock % 60 AS clock,
       round(avg(CASE WHEN measurement = 'vm_memory_utilization' THEN value END), 6) AS vm_memory_utilization,
       round(avg(CASE WHEN measurement = 'system_cpu_util_user' THEN value END), 6) AS system_cpu_util_user,
       round(avg(CASE WHEN measurement = 'net_if_out_eth0' THEN value END), 6) AS net_if_out_eth0
FROM samples
WHERE clock < 1706659200 AND measurement IN ('vm_memory_utilization', 'system_cpu_util_user', 'net_if_out_eth0')
GROUP BY ALL
""")
def system_overview(t: Tables) -> DataFrame:
    metrics = ["vm_memory_utilization", "system_cpu_util_user", "net_if_out_eth0"]
    return rounded(aggregates.overview(t.samples, metrics, since=0, until=AS_OF), *metrics)


@query("D6", """
SELECT host, 1704067200 + (clock - 1704067200) // 5184 * 5184 AS window_start, round(avg(value), 6) AS value
FROM samples WHERE measurement = 'system_cpu_util_user' AND clock >= 1704067200 AND clock < 1706659200 GROUP BY ALL
""")
def panel_mean(t: Tables) -> DataFrame:
    """Thirty days in at most 500 points."""
    return rounded(aggregates.panel_mean(t.samples, "system_cpu_util_user", AS_OF - 30 * 86400, AS_OF, 500), "value")


@query("D17", """
SELECT * FROM (SELECT DISTINCT 'host' AS kind, host AS name FROM samples ORDER BY name LIMIT 50)
UNION ALL SELECT * FROM (SELECT DISTINCT 'measurement', measurement FROM samples ORDER BY 2 LIMIT 50)
""")
def catalogue_names(t: Tables) -> DataFrame:
    parts = [
        aggregates.first_names(t.samples, c).select(F.lit(c).alias("kind"), F.col(c).alias("name"))
        for c in ("host", "measurement")
    ]
    return parts[0].unionByName(parts[1])


@query("F2", "SELECT host, measurement, clock, value FROM hourly ORDER BY clock DESC, host, measurement")
def newest_first(t: Tables) -> DataFrame:
    return t.hourly.orderBy(F.col("clock").desc(), "host", "measurement")


@query("F4", """
SELECT host, measurement, clock, value FROM (
  SELECT *, row_number() OVER (PARTITION BY host, measurement ORDER BY clock) AS rn FROM samples) WHERE rn <= 20
""")
def first_rows_per_series(t: Tables) -> DataFrame:
    return aggregates.first_rows(t.samples)


@query("G3", "SELECT DISTINCT metric FROM forecast")
def distinct_targets(t: Tables) -> DataFrame:
    return aggregates.distinct_names(t.forecast, "metric")


@query("A10", """
SELECT concat(host, ' ', metric) AS target, coalesce(yhat, 0.0) AS value, ds * 1000 AS ts_ms FROM forecast
""")
def series_datapoints(t: Tables) -> DataFrame:
    named = t.forecast.withColumn("target", F.concat_ws(" ", "host", "metric"))
    return aggregates.datapoints(named, "target", "yhat", "ds")


@query("C9", """
WITH spine AS (
  SELECT h.host, s.slot FROM (SELECT DISTINCT host FROM samples) h,
         (SELECT unnest(range(1706659200 - 43199 * 60, 1706659200 + 60, 60)) AS slot) s)
SELECT spine.host, spine.slot, coalesce(n, 0) AS samples FROM spine LEFT JOIN (
  SELECT host, clock - clock % 60 AS slot, count(*) AS n FROM samples GROUP BY ALL) c
ON spine.host = c.host AND spine.slot = c.slot
""")
def dense_minutes(t: Tables) -> DataFrame:
    """Sample counts on a dense minute spine of thirty days."""
    return aggregates.slot_counts(t.samples, AS_OF, minutes=43200)
