"""Labels derived from scores, names and codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed


def _graded(c: Column, levels: list[tuple[float, str]], lowest: str, inclusive: bool) -> Column:
    out = F
    for limit, label in levels:
        out = out.when(c >= limit if inclusive else c > limit, label)
    return out.otherwise(lowest)


def severity(score: Column) -> Column:
    clean = F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))
    return _graded(clean, fixed.SEVERITY_LEVELS, fixed.LOWEST_SEVERITY, inclusive=True)


def model_health(agreement: Column) -> Column:
    return _graded(agreement, fixed.HEALTH_LEVELS, fixed.LOWEST_HEALTH, inclusive=False)


def panel_band(panel: Column, value: Column) -> Column:
    """Colour of the highest band whose lower bound the value reaches."""
    steps = F.array(*[
        F.struct(
            F.lit(name).alias("panel"),
            F.lit(float("-inf") if low is None else low).alias("low"),
            F.lit(colour).alias("colour"),
        )
        for name, low, colour in fixed.PANEL_BANDS
    ])
    reached = F.filter(steps, lambda s: (s["panel"] == panel) & (s["low"] <= value))
    best = F.array_max(F.transform(reached, lambda s: F.struct(s["low"].alias("low"), s["colour"].alias("colour"))))
    return best["colour"]


def _mapped(code: Column, texts: dict[int, str]) -> Column:
    return reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), texts.items(), F).otherwise(None)


def model_status_text(code: Column) -> Column:
    return _mapped(code, fixed.MODEL_STATUS_TEXT)


def risk_code_text(code: Column) -> Column:
    """Text of an exact risk code; other values have none."""
    return _mapped(code, fixed.RISK_CODE_TEXT)


def risk_band_text(level: Column) -> Column:
    """Text of the highest risk code a level reaches."""
    codes = sorted(fixed.RISK_CODE_TEXT.items(), reverse=True)
    return reduce(lambda acc, kv: acc.when(level >= kv[0], kv[1]), codes, F).otherwise(None)


def feature_families(name: Column) -> Column:
    """All families a feature name belongs to, as an array."""
    low = F.lower(name)
    hits = [
        F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]), F.lit(family))
        for family, words in fixed.FEATURE_FAMILIES.items()
    ]
    return F.array_compact(F.array(*hits))


def _has(low: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def search_target(model: Column) -> Column:
    """Dashboard series a trained model offers under the search names."""
    low = F.lower(model)
    cpu = F.when(F.contains(model, F.lit("system_cpu_util")), "prediction_system_cpu_util").when(
        F.contains(model, F.lit("system_cpu_load")), "prediction_cpu_load_avg"
    )
    return F.when(_has(low, "cpu"), cpu).when(_has(low, "memory"), "prediction_memory_util")


def discovery_target(model: Column) -> Column:
    """Dashboard series a trained model offers under the discovery names."""
    low = F.lower(model)
    return (
        F.when(_has(low, "cpu", "processor"), "prediction_cpu_util")
        .when(_has(low, "memory", "ram", "mem"), "prediction_memory_util")
        .when(_has(low, "disk", "fs", "filesystem"), "prediction_disk_util")
    )


def metric_family(name: Column) -> Column:
    """Forecasting family of a metric name; the first matching rule decides."""
    low = F.lower(name)
    return (
        F.when(_has(low, "cpu_util") & ~_has(low, "load"), "cpu_percentage")
        .when(_has(low, "cpu_load"), "load_average")
        .when(_has(low, "memory") & _has(low, "util", "pavailable"), "memory_percentage")
        .when(_has(low, "net_if"), "network_traffic")
        .otherwise("generic")
    )


def version_epoch(version: Column) -> Column:
    """Epoch second in the trailing ``YYYYMMDD_HHMMSS`` of a version text, else NULL."""
    stamp = F.regexp_extract(version, r"(\d{8}_\d{6})$", 1)
    return F.unix_timestamp(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss")))


def version_age_hours(version: Column, as_of: int) -> Column:
    return (F.lit(as_of) - version_epoch(version)).cast("double") / F.lit(3600.0)
