"""Feature set and training set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions.labels import feature_families
from hostpulse.operators import cleaning, features, intervals
from hostpulse.plans import datasets
from hostpulse.registered import query, rounded
from hostpulse.registered.cleaning import CLEAN_WIDE, FILLED_WIDE
from hostpulse.registered.neighbours import KNN_FILLED_SQL, KNN_SQL
from hostpulse.session import materialised
from hostpulse.sources.tables import AS_OF, METRICS, Tables

MINUTES = [180, 360, 720]  # the windows of 5, 15 and 60 minutes hold one hourly row each
HOUR = "CAST((clock // 3600) % 24 AS INTEGER)"
DAY = "CAST((clock // 86400 + 3) % 7 AS INTEGER)"
WEEKEND = f"CASE WHEN {DAY} >= 5 THEN 1 ELSE 0 END"
BUSINESS = f"CASE WHEN {HOUR} BETWEEN 9 AND 17 AND {DAY} < 5 THEN 1 ELSE 0 END"
CALENDAR_SQL = f"{HOUR} AS hour, {DAY} AS day_of_week, {WEEKEND} AS is_weekend, {BUSINESS} AS is_business_hours"
CYCLIC_SQL = f"""sin(2 * pi() * {HOUR} / 24) AS hour_sin, cos(2 * pi() * {HOUR} / 24) AS hour_cos,
  sin(2 * pi() * {DAY} / 7) AS day_sin, cos(2 * pi() * {DAY} / 7) AS day_cos"""


def _filled(t: Tables) -> DataFrame:
    return materialised(cleaning.filled(t.written("wide"), METRICS, by=("host",), rest=None), "filled")


def _round_doubles(df: DataFrame, nudge: float = 0.0) -> DataFrame:
    return rounded(df, *[c for c, k in df.dtypes if k == "double"], nudge=nudge)


def _four(c: str, w: str, suffix: str, std: str) -> list[str]:
    return [
        f"avg({c}) OVER {w} AS {c}_rolling_mean_{suffix}", f"{std.format(c=c, w=w)} AS {c}_rolling_std_{suffix}",
        f"max({c}) OVER {w} AS {c}_rolling_max_{suffix}", f"min({c}) OVER {w} AS {c}_rolling_min_{suffix}",
    ]


#: The deviation of equal values is exactly 0.
STD = "CASE WHEN count({c}) OVER {w} > 1 AND min({c}) OVER {w} = max({c}) OVER {w} THEN 0 ELSE stddev_samp({c}) OVER {w} END"


def _rolling_lag_sql() -> str:
    cols, frames = [], ["o AS (PARTITION BY host ORDER BY clock)"]
    for m in MINUTES:
        frames.append(f"w{m} AS (PARTITION BY host ORDER BY clock RANGE BETWEEN {m * 60 - 1} PRECEDING AND CURRENT ROW)")
    for c in METRICS:
        for m in MINUTES:
            cols += _four(c, f"w{m}", f"{m}m", STD)
        cols += [f"{c} / nullif(lag({c}) OVER o, 0) - 1 AS {c}_rate_change", f"{c} - lag({c}) OVER o AS {c}_diff"]
        cols += [f"lag({c}, {n}) OVER o AS {c}_lag_{n}" for n in (1, 2, 3, 6, 12)]
    for i, a in enumerate(METRICS):
        cols += [f"{a} / nullif({b} + 1e-8, 0) AS {a}_{b}_ratio" for b in METRICS[i + 1 :]]
    calendar = CALENDAR_SQL.replace("AS hour,", "AS hour_of_day,")
    names = [x.rsplit(" AS ", 1)[1] for x in cols]
    some = " AND ".join(f"{n} IS NOT NULL" for n in [*METRICS, *names])
    return (
        f"{CLEAN_WIDE}, made AS (SELECT host, clock, {', '.join(METRICS)}, {', '.join(cols)}, {calendar} FROM cleaned "
        f"WINDOW {', '.join(frames)}), whole AS (SELECT * FROM made WHERE {some})"
    )


ROLLING_LAG_SQL = _rolling_lag_sql()


@query("H4, E2, E4, E6, S5, S8", f"""
WITH {ROLLING_LAG_SQL}
SELECT host, clock, hour_of_day, day_of_week, is_weekend, is_business_hours,
       round(COLUMNS(* EXCLUDE (host, clock, hour_of_day, day_of_week, is_weekend, is_business_hours)) + 1e-9, 6)
FROM whole
""")
def rolling_lag_features(t: Tables) -> DataFrame:
    steady = materialised(cleaning.clean_wide(t.written("wide"), METRICS), "cleaned")
    made = features.rolling_lag_set(steady, METRICS, MINUTES)
    return _round_doubles(made, nudge=1e-9)


def _statistical_columns() -> tuple[list[str], str]:
    cols, frames = [], ["o AS (PARTITION BY host ORDER BY clock)"]
    for n in (3, 5, 10):
        frames.append(f"w{n} AS (PARTITION BY host ORDER BY clock ROWS {n - 1} PRECEDING)")
    for c in METRICS:
        made = []
        for n in (3, 5, 10):
            made += _four(c, f"w{n}", str(n), f"coalesce({STD}, 0)")
        made += [f"coalesce(lag({c}, {n}) OVER o, first_value({c}) OVER o) AS {c}_lag_{n}" for n in (1, 2, 3)]
        made += [
            f"coalesce({c} / nullif(lag({c}) OVER o, 0) - 1, 0) AS {c}_pct_change",
            f"coalesce({c} - lag({c}) OVER o, 0) AS {c}_diff",
            f"CASE WHEN {c}_s > 0 THEN ({c} - {c}_m) / {c}_s ELSE 0 END AS {c}_zscore",
        ]
        for x in made:
            body, name = x.rsplit(" AS ", 1)
            cols.append(f"CASE WHEN {c}_lo <> {c}_hi THEN {body} END AS {name}")
    return cols, ", ".join(frames)


_STAT_COLUMNS, _STAT_FRAMES = _statistical_columns()
_STAT_PARAMS = "SELECT host, " + ", ".join(
    f"avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s, min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in METRICS
)
_CPU = "(system_cpu_util_user + system_cpu_load_all_avg1) / 2"
DOMAIN_SQL = f"""{_CPU} AS cpu_avg, greatest(system_cpu_util_user, system_cpu_load_all_avg1) AS cpu_max,
  CASE WHEN {_CPU} > 90 THEN 3 WHEN {_CPU} > 80 THEN 2 WHEN {_CPU} > 70 THEN 1 ELSE 0 END AS cpu_utilization_severity,
  vm_memory_utilization AS memory_avg, CASE WHEN vm_memory_utilization > 95 THEN 1 ELSE 0 END AS memory_pressure,
  net_if_out_eth0 AS network_avg,
  ((100 - {_CPU}) / 100 + (100 - vm_memory_utilization) / 100) / 2 AS system_health_score"""


@query("H5, E3, E5, E10", f"""
WITH {FILLED_WIDE}, p AS ({_STAT_PARAMS} FROM filled GROUP BY host),
made AS (SELECT f.host, f.clock, {', '.join(METRICS)}, {', '.join(_STAT_COLUMNS)}
  FROM (SELECT f.*, p.* EXCLUDE host FROM filled f JOIN p ON f.host = p.host) f WINDOW {_STAT_FRAMES})
SELECT host, clock, round(COLUMNS(* EXCLUDE (host, clock)), 6) FROM made
""")
def statistical_features(t: Tables) -> DataFrame:
    return _round_doubles(features.statistical_set(_filled(t), METRICS))


@query("H6", f"""
WITH {FILLED_WIDE}, made AS (SELECT *, {DOMAIN_SQL} FROM filled)
SELECT host, clock, cpu_utilization_severity, memory_pressure,
       round(COLUMNS(* EXCLUDE (host, clock, cpu_utilization_severity, memory_pressure)) + 1e-9, 6) FROM made
""")
def domain_features(t: Tables) -> DataFrame:
    return _round_doubles(features.domain_set(_filled(t), METRICS), nudge=1e-9)


@query("S5, S6", f"""
SELECT host, clock, {CALENDAR_SQL}, round(sin(2 * pi() * {HOUR} / 24), 6) AS hour_sin,
  round(cos(2 * pi() * {HOUR} / 24), 6) AS hour_cos, round(sin(2 * pi() * {DAY} / 7), 6) AS day_sin,
  round(cos(2 * pi() * {DAY} / 7), 6) AS day_cos FROM wide
""")
def calendar_features(t: Tables) -> DataFrame:
    return _round_doubles(features.calendar_set(t.wide.select("host", "clock")))


@query("S7", f"""
WITH {FILLED_WIDE}
SELECT host, clock, {', '.join(f'coalesce({c}, 0) AS {c}' for c in METRICS)},
       {HOUR} AS hour, {DAY} AS day_of_week, {WEEKEND} AS is_weekend FROM filled
""")
def simple_features(t: Tables) -> DataFrame:
    return features.simple_set(t.wide, METRICS)


@query("S8", f"""
WITH {FILLED_WIDE}
SELECT host, clock, {', '.join(f'round({a} / ({b} + 1e-8), 6) AS {a}_{b}_ratio'
                               for i, a in enumerate(METRICS) for b in METRICS[i + 1:])} FROM filled
""")
def metric_ratios(t: Tables) -> DataFrame:
    return _round_doubles(_filled(t).select("host", "clock", *features.pair_ratios(METRICS)))


_PIPELINE = datasets.pipeline_features(METRICS)
_MEDIANS = f"""
med AS (SELECT host, {', '.join(f'median({c}) AS {c}_med' for c in METRICS)} FROM wide GROUP BY host),
imputed AS (SELECT w.host, w.clock, {', '.join(f'coalesce({c}, {c}_med, 0.0) AS {c}' for c in METRICS)}
            FROM wide w JOIN med ON w.host = med.host)"""
_TAIL_SQL = f"""
p AS ({_STAT_PARAMS} FROM imputed GROUP BY host),
made AS (SELECT f.host, f.clock, {', '.join(METRICS)}, {CALENDAR_SQL}, {CYCLIC_SQL}, {', '.join(_STAT_COLUMNS)},
                {DOMAIN_SQL}
  FROM (SELECT f.*, p.* EXCLUDE host FROM imputed f JOIN p ON f.host = p.host) f WINDOW {_STAT_FRAMES}),
even AS (SELECT host, clock, {', '.join(f'coalesce({c}, 0)::DOUBLE AS {c}' for c in _PIPELINE)} FROM made),
s AS (SELECT host, {', '.join(f'quantile_cont({c}, [0.25, 0.5, 0.75]) AS {c}_q' for c in _PIPELINE)}
      FROM even GROUP BY host)
SELECT e.host, e.clock, {', '.join(
    f'round((e.{c} - {c}_q[2]) / CASE WHEN {c}_q[3] - {c}_q[1] <= greatest(abs({c}_q[1]), abs({c}_q[3])) * power(2, -49) THEN 1 ELSE {c}_q[3] - {c}_q[1] END, 4) AS {c}'
    for c in _PIPELINE)}
FROM even e JOIN s ON e.host = s.host
"""


@query("H10", f"WITH {_MEDIANS},{_TAIL_SQL}")
def feature_pipeline(t: Tables) -> DataFrame:
    """Fit on the frame and transform it."""
    _, made = datasets.fit_features(t.written("wide"), METRICS)
    return rounded(made, *_PIPELINE, digits=4)


@query("H10, H9", f"WITH {KNN_SQL}, imputed AS ({KNN_FILLED_SQL}),{_TAIL_SQL}")
def feature_pipeline_of_neighbours(t: Tables) -> DataFrame:
    """The same with gaps filled from the nearest rows: fitted, then applied to its own data."""
    wide = t.written("wide")
    params, _ = datasets.fit_features(wide, METRICS, imputer="neighbours")
    return rounded(datasets.transform_features(wide, METRICS, params, reference=wide), *_PIPELINE, digits=4)


_SUFFIXES = [n.removeprefix("x") for n in features.statistical_names("x")]


@query("S14", f"""
WITH names AS (
  SELECT measurement AS feature FROM base UNION
  SELECT concat(measurement, suffix) FROM (SELECT DISTINCT measurement FROM base),
    (VALUES {', '.join(f"('{x}')" for x in _SUFFIXES)}) s(suffix))
SELECT family, feature FROM names, (VALUES ('temporal', 'hour|day|weekend|business|sin|cos'), ('cpu', 'cpu'),
  ('memory', 'memory|ram'), ('disk', 'disk|fs|filesystem'), ('network', 'net'), ('rolling', 'rolling'), ('lag', 'lag'),
  ('derived', 'avg|max|severity|pressure|critical|health')) r(family, words)
WHERE regexp_matches(lower(feature), words)
""")
def feature_groups(t: Tables) -> DataFrame:
    """Families of every metric in the data and of its statistical features."""
    metric = t.base.select("measurement").distinct()
    suffixes = F.array(F.lit(""), *[F.lit(x) for x in _SUFFIXES])
    names = metric.select(F.explode(F.transform(suffixes, lambda x: F.concat("measurement", x))).alias("feature"))
    return names.select(F.explode(feature_families(F.col("feature"))).alias("family"), "feature")


def _labelled_sql() -> str:
    return f"""
WITH {ROLLING_LAG_SQL},
rows_of AS (SELECT host, clock, name, value FROM (SELECT host, clock, COLUMNS(* EXCLUDE (host, clock))::DOUBLE FROM whole)
  UNPIVOT (value FOR name IN (COLUMNS(* EXCLUDE (host, clock))))),
stats AS (SELECT host, name, avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi FROM rows_of GROUP BY ALL)
SELECT r.host, r.clock, r.name, round((r.value - m) / CASE WHEN lo = hi OR s <= greatest(abs(lo), abs(hi)) * power(2, -49) THEN 1 ELSE s END, 4) AS value,
  CASE WHEN EXISTS (SELECT 1 FROM alert_times a WHERE a.host = r.host
    AND r.clock BETWEEN a.alert_clock - 1800 AND a.alert_clock + 1800) THEN 1 ELSE 0 END AS is_anomaly
FROM rows_of r JOIN stats ON r.host = stats.host AND r.name = stats.name
"""


@query("H11", _labelled_sql())
def labelled_dataset(t: Tables) -> DataFrame:
    """The training set, one row per feature for comparison."""
    made = datasets.labelled_dataset(t.written("wide"), METRICS, t.alert_times, MINUTES)
    names = [c for c in made.columns if c not in ("host", "clock", "is_anomaly")]
    return rounded(made.unpivot(["host", "clock", "is_anomaly"], names, "name", "value"), "value", digits=4)


@query("H12", """
WITH recent AS (SELECT * FROM samples WHERE clock >= 1706659200 - 168 * 3600 AND clock < 1706659200),
frame AS (SELECT host, clock, count(*) AS known FROM recent GROUP BY ALL),
alerted AS (
  SELECT h.host, count(*) AS alert_rows FROM alerts a JOIN problems e ON a.eventid = e.eventid
  JOIN triggers t ON e.objectid = t.triggerid JOIN functions f ON t.triggerid = f.triggerid
  JOIN items i ON f.itemid = i.itemid JOIN hosts h ON i.hostid = h.hostid
  WHERE a.clock >= 1706659200 - 8 * 86400 AND e.source = 0 GROUP BY h.host)
SELECT frame.host, count(*) AS metric_rows, coalesce(max(alert_rows), 0) AS alert_rows,
       round(sum(known) / (count(*) * 5.0) * 100, 2) AS completeness, 100.0::DOUBLE AS consistency
FROM frame LEFT JOIN alerted ON frame.host = alerted.host GROUP BY frame.host
""")
def collected_training_data(t: Tables) -> DataFrame:
    week, before = t.since(AS_OF - 168 * 3600), t.since(AS_OF - 8 * 86400 - 30)
    tables = dict(alerts=before.alerts, events=before.problems, triggers=t.triggers, functions=t.functions, items=t.items, hosts=t.hosts)
    data = datasets.collect_training_data(week.samples, AS_OF, 168, METRICS, relations_of_alerts=tables)
    rows = data.metrics.groupBy("host").agg(F.count("*").alias("metric_rows"))
    alerts = data.alerts.groupBy(F.col("hostname").alias("host")).agg(F.count("*").alias("alert_rows"))
    return rows.join(alerts, "host", "left").join(data.quality, "host").select(
        "host", "metric_rows", F.coalesce("alert_rows", F.lit(0)).alias("alert_rows"), "completeness", "consistency"
    )
