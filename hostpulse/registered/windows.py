"""Rolling, lag, change, fill, split and trend queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import cleaning, dedupe, windows
from hostpulse.registered import query, r, rounded
from hostpulse.sources.tables import METRICS, Tables


_STD = "CASE WHEN count(value) OVER {w} > 1 AND min(value) OVER {w} = max(value) OVER {w} THEN 0 ELSE stddev_samp(value) OVER {w} END"


def _frames_sql(source: str, frames: dict[str, str], std: str = "{s}") -> str:
    parts, named = [], []
    for suffix, frame in frames.items():
        w = f"w{suffix}"
        named.append(f"{w} AS (PARTITION BY host, measurement ORDER BY clock {frame})")
        parts.append(
            f"round(avg(value) OVER {w}, 6) AS value_rolling_mean_{suffix}, "
            f"round({std.format(s=_STD.format(w=w))}, 6) AS value_rolling_std_{suffix}, "
            f"max(value) OVER {w} AS value_rolling_max_{suffix}, min(value) OVER {w} AS value_rolling_min_{suffix}"
        )
    return f"SELECT host, measurement, clock, value, {', '.join(parts)} FROM {source} WINDOW {', '.join(named)}"


def _round_rolling(df: DataFrame) -> DataFrame:
    return rounded(df, *[c for c in df.columns if "_mean_" in c or "_std_" in c])


@query("E2", _frames_sql("samples", {
    f"{m}m": f"RANGE BETWEEN {m * 60 - 1} PRECEDING AND CURRENT ROW" for m in (5, 15, 60)
}))
def rolling_by_time(t: Tables) -> DataFrame:
    return _round_rolling(windows.rolling_by_time(t.written("samples")))


@query("E3", _frames_sql("hourly", {
    str(n): f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW" for n in (3, 5, 10)
}, std="coalesce({s}, 0)"))
def rolling_by_rows(t: Tables) -> DataFrame:
    return _round_rolling(windows.rolling_by_rows(t.written("hourly")))


@query("E4", """
SELECT host, measurement, clock, value, lag(value, 1) OVER w AS value_lag_1, lag(value, 2) OVER w AS value_lag_2,
       lag(value, 3) OVER w AS value_lag_3, lag(value, 6) OVER w AS value_lag_6, lag(value, 12) OVER w AS value_lag_12
FROM hourly WINDOW w AS (PARTITION BY host, measurement ORDER BY clock)
""")
def lagged_values(t: Tables) -> DataFrame:
    return windows.lagged(t.written("hourly"))


@query("E5", """
SELECT host, measurement, clock, value,
       coalesce(lag(value, 1) OVER w, first_value(value) OVER w) AS value_lag_1,
       coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS value_lag_2,
       coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS value_lag_3
FROM hourly WINDOW w AS (PARTITION BY host, measurement ORDER BY clock)
""")
def lagged_values_filled(t: Tables) -> DataFrame:
    return windows.lagged_filled(t.written("hourly"))


@query("E6", """
SELECT host, measurement, clock, value, round(value / nullif(lag(value) OVER w, 0) - 1, 6) AS value_rate_change,
       round(value - lag(value) OVER w, 6) AS value_diff
FROM hourly WINDOW w AS (PARTITION BY host, measurement ORDER BY clock)
""")
def changes(t: Tables) -> DataFrame:
    return rounded(windows.changed(t.written("hourly")), "value_rate_change", "value_diff")


@query("E6", """
SELECT host, measurement, clock, value,
       round(coalesce(value / nullif(lag(value) OVER w, 0) - 1, 0), 6) AS value_pct_change,
       round(coalesce(value - lag(value) OVER w, 0), 6) AS value_diff
FROM hourly WINDOW w AS (PARTITION BY host, measurement ORDER BY clock)
""")
def changes_filled(t: Tables) -> DataFrame:
    return rounded(windows.changed(t.written("hourly"), ratio_name="pct_change", fill=0.0), "value_pct_change", "value_diff")


_FILL = """coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY host ORDER BY clock ROWS UNBOUNDED PRECEDING),
  first_value({c} IGNORE NULLS) OVER (PARTITION BY host ORDER BY clock ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
  (SELECT median({c}) FROM wide m WHERE m.host = wide.host), 0) AS {c}"""
_FILL_SQL = f"SELECT host, clock, {', '.join(_FILL.format(c=c) for c in METRICS)} FROM wide"


@query("E7", _FILL_SQL)
def filled_gaps(t: Tables) -> DataFrame:
    return cleaning.filled(t.written("wide"), METRICS, by=("host",))


_NEAR = """last_value({c} IGNORE NULLS) OVER p AS {c}_pv, first_value({c} IGNORE NULLS) OVER f AS {c}_nv,
  last_value(CASE WHEN {c} IS NOT NULL THEN clock END IGNORE NULLS) OVER p AS {c}_pt,
  first_value(CASE WHEN {c} IS NOT NULL THEN clock END IGNORE NULLS) OVER f AS {c}_nt"""
_BETWEEN = """round(coalesce({c}, CASE WHEN {c}_pt IS NULL THEN NULL WHEN {c}_nt IS NULL THEN {c}_pv
  ELSE {c}_pv + ({c}_nv - {c}_pv) * (CAST(clock - {c}_pt AS DOUBLE) / ({c}_nt - {c}_pt)) END) + 1e-9, 6) AS {c}"""


@query("E8", f"""
SELECT host, clock, {', '.join(_BETWEEN.format(c=c) for c in METRICS)} FROM (
  SELECT *, {', '.join(_NEAR.format(c=c) for c in METRICS)} FROM wide
  WINDOW p AS (PARTITION BY host ORDER BY clock ROWS UNBOUNDED PRECEDING),
         f AS (PARTITION BY host ORDER BY clock ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""")
def interpolated_gaps(t: Tables) -> DataFrame:
    return rounded(cleaning.interpolated(t.written("wide"), METRICS, by=("host",)), *METRICS, nudge=1e-9)


@query("E9", """
SELECT host, measurement, clock, round(median(value) OVER (PARTITION BY host, measurement ORDER BY clock
  ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS value FROM hourly
""")
def smoothed_spikes(t: Tables) -> DataFrame:
    return rounded(windows.smoothed(t.written("hourly")), "value")


@query("E10", """
SELECT h.*, round(CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END, 6) AS value_zscore
FROM hourly h JOIN (SELECT host, measurement, avg(value) AS m, stddev_samp(value) AS s FROM hourly GROUP BY ALL) b
ON h.host = b.host AND h.measurement = b.measurement
""")
def standardised_values(t: Tables) -> DataFrame:
    return rounded(windows.standardised(t.written("hourly")), "value_zscore")


@query("E11", """
SELECT host, measurement, clock, value, CASE WHEN
  row_number() OVER (PARTITION BY host, measurement ORDER BY clock) <=
  count(*) OVER (PARTITION BY host, measurement) * 8 // 10 THEN 'train' ELSE 'test' END AS part FROM hourly
""")
def chronological_split(t: Tables) -> DataFrame:
    return windows.split_by_time(t.written("hourly"))


@query("E12", """
SELECT host, clock, CAST(least((rn - 1) // (n // 3), 2) AS INTEGER) AS fold FROM (
  SELECT host, clock, row_number() OVER (PARTITION BY host ORDER BY clock) AS rn,
         count(*) OVER (PARTITION BY host) AS n FROM wide)
""")
def validation_blocks(t: Tables) -> DataFrame:
    return windows.fold_by_time(t.written("wide").select("host", "clock"))


@query("E13", """
SELECT host, metric, model, points, round(slope, 6) AS slope, CASE WHEN slope > 0.01 THEN 'increasing'
  WHEN slope < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend_direction
FROM (SELECT host, metric, model, count(*) AS points, regr_slope(yhat, rn) AS slope FROM (
  SELECT *, row_number() OVER (PARTITION BY host, metric, model ORDER BY ds) AS rn FROM forecast) GROUP BY ALL)
""")
def forecast_trend(t: Tables) -> DataFrame:
    return rounded(windows.trend(t.written("forecast"), ["host", "metric", "model"], "yhat", "ds"), "slope")


@query("F6", """
SELECT host, measurement, clock, value FROM (
  SELECT host, measurement, clock - clock % 3600 AS clock, value,
         row_number() OVER (PARTITION BY host, measurement, clock - clock % 3600 ORDER BY event_id) AS rn FROM base)
WHERE rn = 1 ORDER BY clock
""")
def first_sample_per_hour(t: Tables) -> DataFrame:
    hourly = t.base.select(
        "host", "measurement", F.expr("clock div 3600L * 3600L").alias("clock"), "value", "event_id"
    )
    return dedupe.first_per_time(hourly, "event_id").drop("event_id").orderBy("clock", "host", "measurement")


@query("M2", """
SELECT host, measurement, clock, arg_max(value, event_id) AS value FROM base GROUP BY ALL
""")
def latest_sample_per_second(t: Tables) -> DataFrame:
    """The store's overwrite rule on samples delivered twice by overlapping exports."""
    once = t.base.select("host", "measurement", "clock", "value", "event_id")
    return dedupe.latest_per_second(once.unionByName(once), "event_id").drop("event_id")
