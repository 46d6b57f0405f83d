"""Filters on columns and series, caps, scaling, imputation and quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import numeric
from hostpulse.operators import aggregates, cleaning, profiles, quality, windows
from hostpulse.registered import query, r, rounded
from hostpulse.session import materialised
from hostpulse.sources.tables import AS_OF, METRICS, Tables

LONG = f"""
long AS (SELECT host, clock, measurement, value FROM wide
  UNPIVOT INCLUDE NULLS (value FOR measurement IN ({', '.join(METRICS)})))"""


def long(t: Tables) -> DataFrame:
    """The sparse wide frame as rows, gaps included."""
    return aggregates.to_long(t.written("wide"), METRICS)


@query("B9", """
SELECT host, clock, coalesce(vm_memory_utilization, 0.0) AS vm_memory_utilization, 0.0::DOUBLE AS agent_ping,
       coalesce(proc_num_run, 0.0) AS proc_num_run FROM wide
""")
def aligned_features(t: Tables) -> DataFrame:
    return cleaning.aligned(t.wide, ["vm_memory_utilization", "agent_ping", "proc_num_run"])


@query("B10", f"""
WITH {LONG}
SELECT l.* FROM long l JOIN (
  SELECT host, measurement FROM long GROUP BY ALL HAVING (count(*) - count(value)) / count(*)::DOUBLE < 0.8) k
ON l.host = k.host AND l.measurement = k.measurement
""")
def dense_series(t: Tables) -> DataFrame:
    return cleaning.dense_series(long(t))


@query("B11", """
WITH flagged AS (SELECT host, measurement, clock, CASE WHEN measurement = 'proc_num_run' THEN 1.0 ELSE value END AS value
                 FROM hourly)
SELECT f.host, f.measurement, f.clock, f.value::DOUBLE AS value FROM flagged f JOIN (
  SELECT host, measurement FROM flagged GROUP BY ALL HAVING count(DISTINCT value) > 1) k
ON f.host = k.host AND f.measurement = k.measurement
""")
def varying_series(t: Tables) -> DataFrame:
    """One metric is made constant first, so that there is something to drop."""
    flat = F.when(F.col("measurement") == "proc_num_run", F.lit(1.0)).otherwise(F.col("value"))
    return cleaning.varying_series(t.hourly.withColumn("value", flat)).select("host", "measurement", "clock", "value")


@query("B12", """
SELECT h.* FROM hourly h JOIN (
  SELECT host, measurement FROM hourly GROUP BY ALL HAVING count(*) >= 175) k
ON h.host = k.host AND h.measurement = k.measurement
""")
def long_enough_series(t: Tables) -> DataFrame:
    return cleaning.long_enough(t.hourly, minimum=175)


@query("B13", """
SELECT event_id, coalesce(CASE WHEN value <= 100 THEN value END, 0.0) AS a,
       coalesce(CASE WHEN value > 50 THEN value END, 0.0) AS b
FROM base
""")
def finite_results(t: Tables) -> DataFrame:
    """Maps holding NaN and infinities, cleaned."""
    a = F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))
    b = F.when(F.col("value") <= 50, F.lit(float("inf"))).otherwise(F.col("value"))
    cleaned = numeric.clean_map(F.create_map(F.lit("a"), a, F.lit("b"), b))
    return t.base.select("event_id", cleaned.alias("m")).select(
        "event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b")
    )


FILLED_WIDE = "filled AS (SELECT host, clock, " + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER p, first_value({c} IGNORE NULLS) OVER f) AS {c}" for c in METRICS
) + """ FROM wide WINDOW p AS (PARTITION BY host ORDER BY clock ROWS UNBOUNDED PRECEDING),
  f AS (PARTITION BY host ORDER BY clock ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""
CLEAN_WIDE = FILLED_WIDE + ",\nband AS (SELECT host, " + ", ".join(
    f"quantile_cont({c}, 0.25) AS {c}_a, quantile_cont({c}, 0.75) AS {c}_b" for c in METRICS
) + " FROM filled GROUP BY host),\ncleaned AS (SELECT f.host, f.clock, " + ", ".join(
    f"least(greatest({c}, {c}_a - 1.5 * ({c}_b - {c}_a)), {c}_b + 1.5 * ({c}_b - {c}_a)) AS {c}" for c in METRICS
) + " FROM filled f JOIN band b ON f.host = b.host)"


@query("H1, S9", f"WITH {CLEAN_WIDE} SELECT host, clock, {', '.join(f'round({c}, 6) AS {c}' for c in METRICS)} FROM cleaned")
def cleaned_metrics(t: Tables) -> DataFrame:
    return rounded(cleaning.clean_wide(t.written("wide"), METRICS), *METRICS)


@query("H1", f"""
WITH {CLEAN_WIDE},
rows_of AS (SELECT host, clock, measurement, value FROM cleaned
  UNPIVOT INCLUDE NULLS (value FOR measurement IN ({', '.join(METRICS)})))
SELECT host, clock, measurement, round(value, 6) AS value FROM rows_of
""")
def cleaned_series(t: Tables) -> DataFrame:
    return rounded(cleaning.clean(long(t)), "value")


@query("H2", """
WITH b AS (SELECT host, measurement, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM hourly GROUP BY ALL)
SELECT h.host, h.measurement, h.clock, round(CASE WHEN q3 > q1
  THEN least(greatest(value, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)) ELSE value END, 6) AS value
FROM hourly h JOIN b ON h.host = b.host AND h.measurement = b.measurement
""")
def widely_capped(t: Tables) -> DataFrame:
    return rounded(cleaning.iqr_capped(t.written("hourly"), 3.0, only_spread=True), "value").select(
        "host", "measurement", "clock", "value"
    )


_PREPARED = f"""
WITH {LONG},
dense AS (SELECT l.* FROM long l JOIN (SELECT host, measurement FROM long GROUP BY ALL
          HAVING (count(*) - count(value)) / count(*)::DOUBLE < 0.8) k
          ON l.host = k.host AND l.measurement = k.measurement),
full_rows AS (SELECT host, measurement, clock, coalesce(
    last_value(value IGNORE NULLS) OVER (PARTITION BY host, measurement ORDER BY clock ROWS UNBOUNDED PRECEDING),
    first_value(value IGNORE NULLS) OVER (PARTITION BY host, measurement ORDER BY clock
                                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS value FROM dense),
b AS (SELECT host, measurement, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
      FROM full_rows GROUP BY ALL HAVING count(DISTINCT value) > 1 AND count(*) >= 10)
SELECT f.host, f.measurement, f.clock, round(CASE WHEN q3 > q1
  THEN least(greatest(value, q1 - 3 * (q3 - q1)), q3 + 3 * (q3 - q1)) ELSE value END, 6) AS value
FROM full_rows f JOIN b ON f.host = b.host AND f.measurement = b.measurement
"""


@query("H3, B10, B11, B12", _PREPARED)
def prepared_training_rows(t: Tables) -> DataFrame:
    return rounded(cleaning.prepare_training(long(t)), "value").select("host", "measurement", "clock", "value")


def _scaling_sql(center: str, scale: str) -> str:
    params = ", ".join(f"{center.format(c=c)} AS {c}_m, {scale.format(c=c)} AS {c}_s, min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in METRICS)
    out = ", ".join(
        f"round((f.{c} - {c}_m) / CASE WHEN {c}_lo = {c}_hi OR {c}_s <= greatest(abs({c}_lo), abs({c}_hi)) * power(2, -49) THEN 1 ELSE {c}_s END, 6) AS {c}" for c in METRICS
    )
    return f"""WITH {FILLED_WIDE}, p AS (SELECT host, {params} FROM filled GROUP BY host)
SELECT f.host, f.clock, {out} FROM filled f JOIN p ON f.host = p.host"""


def _scaled(t: Tables, method: str) -> DataFrame:
    full = materialised(cleaning.filled(t.written("wide"), METRICS, by=("host",), rest=None), "filled")
    return rounded(cleaning.scaled(full, METRICS, cleaning.fit_scaling(full, METRICS, method)), *METRICS)


@query("H7", _scaling_sql("avg({c})", "stddev_pop({c})"))
def standard_scaled(t: Tables) -> DataFrame:
    return _scaled(t, "standard")


@query("H7", _scaling_sql("min({c})", "max({c}) - min({c})"))
def range_scaled(t: Tables) -> DataFrame:
    return _scaled(t, "minmax")


@query("H8", _scaling_sql("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def robust_scaled(t: Tables) -> DataFrame:
    return _scaled(t, "robust")


@query("H9", "SELECT w.host, w.clock, " + ", ".join(f"round(coalesce({c}, {c}_m), 6) AS {c}" for c in METRICS) + """
FROM wide w JOIN (SELECT host, """ + ", ".join(f"median({c}) AS {c}_m" for c in METRICS) + """
FROM wide GROUP BY host) m ON w.host = m.host""")
def median_imputed(t: Tables) -> DataFrame:
    return rounded(cleaning.median_imputed(t.written("wide"), METRICS), *METRICS)


_KNOWN = " + ".join(f"count({c})" for c in METRICS)


@query("D8", f"""
SELECT host, round(({_KNOWN}) / (count(*) * 6.0) * 100 + 100 / 6.0, 2) AS completeness,
       round(5 / 6.0 * 100, 2) AS consistency, 100.0::DOUBLE AS accuracy,
       round((({_KNOWN}) / (count(*) * 6.0) * 100 + 100 / 6.0 + 5 / 6.0 * 100 + 100.0) / 3, 2) AS overall_score
FROM wide GROUP BY host
""")
def frame_quality(t: Tables) -> DataFrame:
    """Quality of the metric columns and the host tag; accuracy comes from the forest in ``data_quality_accuracy``."""
    return quality.frame_quality(t.wide, [*METRICS, "host"])


@query("D9", f"""
WITH {LONG},
steps AS (SELECT *, value - lag(value) OVER (PARTITION BY host, measurement ORDER BY clock) AS d FROM long),
q AS (SELECT host, measurement, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM long GROUP BY ALL)
SELECT s.host, s.measurement, count(*) AS rows, round(coalesce(least(1.0, greatest(0.0,
  0.4 * count(value) / count(*)
  + 0.3 * CASE WHEN count(*) > 1 THEN 1 / (1 + stddev_samp(d)) ELSE 0.5 END
  + 0.3 * (1 - count(CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN 1 END)
               / count(*)::DOUBLE))), 0.0), 6) AS quality_score
FROM steps s JOIN q ON s.host = q.host AND s.measurement = q.measurement GROUP BY s.host, s.measurement
""")
def series_quality(t: Tables) -> DataFrame:
    return rounded(quality.series_quality(long(t)), "quality_score")


@query("D10", f"""
WITH {LONG}
SELECT host, measurement, count(*) AS sample_count,
       round((count(*) - count(value)) / count(*)::DOUBLE * 100, 6) AS missing_values_pct,
       round(coalesce(avg(value), 0.0) + 1e-9, 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS std,
       coalesce(min(value), 0.0) AS min, coalesce(max(value), 0.0) AS max
FROM long GROUP BY host, measurement
""")
def training_profile(t: Tables) -> DataFrame:
    return rounded(
        rounded(quality.training_profile(long(t)), "missing_values_pct", "std"), "mean", nudge=1e-9
    )


_FAMILY = """CASE WHEN contains(lower(measurement), 'cpu_util') AND NOT contains(lower(measurement), 'load') THEN 'cpu_percentage'
  WHEN contains(lower(measurement), 'cpu_load') THEN 'load_average'
  WHEN contains(lower(measurement), 'memory') AND (contains(lower(measurement), 'util')
       OR contains(lower(measurement), 'pavailable')) THEN 'memory_percentage'
  WHEN contains(lower(measurement), 'net_if') THEN 'network_traffic' ELSE 'generic' END"""
PROFILES = f"""
stats AS (SELECT host, measurement, {_FAMILY} AS family, avg(value) AS mean, stddev_samp(value) AS std,
                 min(value) AS min, max(value) AS max FROM hourly GROUP BY ALL),
profiles AS (SELECT *,
  CASE family WHEN 'cpu_percentage' THEN 'percentage' WHEN 'memory_percentage' THEN 'percentage' ELSE family END AS data_type,
  CASE family WHEN 'cpu_percentage' THEN '%' WHEN 'memory_percentage' THEN '%' WHEN 'load_average' THEN 'none'
       WHEN 'network_traffic' THEN 'bps' ELSE 'unknown' END AS unit,
  family <> 'generic' AS business_hours,
  CASE family WHEN 'cpu_percentage' THEN 15.0::DOUBLE WHEN 'load_average' THEN 8.0 WHEN 'memory_percentage' THEN 12.0
       WHEN 'network_traffic' THEN 5.0 ELSE 10.0 END AS seasonality_scale,
  CASE WHEN family IN ('cpu_percentage', 'network_traffic') THEN 0.85::DOUBLE ELSE 0.8 END AS interval_width,
  CASE WHEN family IN ('cpu_percentage', 'load_average', 'memory_percentage') THEN 0.0::DOUBLE END AS floor,
  CASE WHEN family IN ('cpu_percentage', 'memory_percentage') THEN 'logistic'
       WHEN family = 'load_average' AND NOT (mean < 2 AND max < 5) THEN 'logistic' ELSE 'linear' END AS growth,
  CASE family WHEN 'cpu_percentage' THEN 0.001::DOUBLE WHEN 'memory_percentage' THEN 0.005 WHEN 'network_traffic' THEN 0.08
       WHEN 'load_average' THEN CASE WHEN mean < 2 AND max < 5 THEN 0.05 ELSE 0.01 END ELSE 0.05 END AS changepoint_scale,
  CASE WHEN family IN ('cpu_percentage', 'memory_percentage') THEN 100.0::DOUBLE
       WHEN family = 'load_average' AND NOT (mean < 2 AND max < 5) THEN greatest(16.0, max * 1.5) END AS cap,
  CASE WHEN family IN ('load_average', 'network_traffic') THEN 'percentile' ELSE 'iqr' END AS outlier_method,
  CASE family WHEN 'load_average' THEN 0.95::DOUBLE WHEN 'network_traffic' THEN 0.98 WHEN 'memory_percentage' THEN 1.5
       ELSE 2.0 END AS outlier_factor,
  family <> 'memory_percentage' AS smooth,
  CASE WHEN family = 'memory_percentage' THEN 'forward_fill' ELSE 'interpolate' END AS fill,
  CASE WHEN family = 'load_average' AND max > 1000 THEN 1000.0::DOUBLE
       WHEN family = 'load_average' AND max > 100 THEN 100.0 ELSE 1.0 END AS scale_factor,
  CASE family WHEN 'cpu_percentage' THEN 15.0::DOUBLE WHEN 'memory_percentage' THEN 12.0 WHEN 'network_traffic' THEN 30.0
       ELSE 25.0 END AS target_mape,
  CASE family WHEN 'cpu_percentage' THEN 5.0::DOUBLE WHEN 'memory_percentage' THEN 3.0 WHEN 'load_average' THEN mean * 0.3
       ELSE std END AS target_mae
  FROM stats)"""
KEPT = """
q AS (SELECT host, measurement, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3,
             quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.98) AS q98 FROM hourly GROUP BY ALL),
kept AS (SELECT h.host, h.measurement, h.clock, h.value, p.smooth, p.scale_factor FROM hourly h
  JOIN q ON h.host = q.host AND h.measurement = q.measurement
  JOIN profiles p ON h.host = p.host AND h.measurement = p.measurement
  WHERE CASE WHEN outlier_method = 'iqr' THEN value BETWEEN q1 - outlier_factor * (q3 - q1) AND q3 + outlier_factor * (q3 - q1)
             WHEN outlier_factor = 0.98 THEN value <= q98 ELSE value <= q95 END)"""


@query("J1, S13", f"""
WITH {PROFILES}
SELECT * REPLACE (round(mean + 1e-9, 6) AS mean, round(std, 6) AS std, round(target_mae, 6) AS target_mae,
                  round(cap, 6) AS cap) FROM profiles
""")
def metric_profiles(t: Tables) -> DataFrame:
    return rounded(
        rounded(profiles.metric_profiles(t.hourly), "std", "target_mae", "cap"), "mean", nudge=1e-9
    )


@query("H13", f"WITH {PROFILES}, {KEPT} SELECT host, measurement, clock, value FROM kept")
def without_profile_outliers(t: Tables) -> DataFrame:
    return profiles.without_outliers(t.written("hourly"), profiles.metric_profiles(t.written("hourly"))).select(
        "host", "measurement", "clock", "value"
    )


PREPARED = """
prepared AS (SELECT host, measurement, clock, CASE WHEN smooth THEN median(value / scale_factor) OVER (
  PARTITION BY host, measurement ORDER BY clock ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)
  ELSE value / scale_factor END AS value FROM kept)"""


@query("H14", f"WITH {PROFILES}, {KEPT}, {PREPARED} SELECT host, measurement, clock, round(value, 6) AS value FROM prepared")
def prepared_series(t: Tables) -> DataFrame:
    return rounded(profiles.prepared_series(t.written("hourly"), profiles.metric_profiles(t.written("hourly"))), "value").select(
        "host", "measurement", "clock", "value"
    )


@query("H15", f"""
WITH {PROFILES}
SELECT b.host, b.measurement, b.clock AS ds, b.value AS y, p.cap, p.floor,
       CASE WHEN business_hours THEN CASE WHEN (b.clock // 3600) % 24 BETWEEN 9 AND 17
            AND (b.clock // 86400 + 3) % 7 < 5 THEN 1 ELSE 0 END END AS is_business_hour
FROM (SELECT host, measurement, clock, value, row_number() OVER (PARTITION BY host, measurement, clock
      ORDER BY event_id) AS rn FROM base) b
JOIN profiles p ON b.host = p.host AND b.measurement = p.measurement WHERE rn = 1
""")
def regression_frame(t: Tables) -> DataFrame:
    return profiles.regression_frame(
        t.base.select("host", "measurement", "clock", "value", "event_id"),
        profiles.metric_profiles(t.hourly),
        order="event_id",
    )
