"""Missing values, sparse and constant series, outlier caps, alignment and scaling.

Series work in long form (one row per key, metric and time) so that hosts with different
metrics share one plan; wide frames take fitted parameters with one row per host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions.numeric import clip, finite
from hostpulse.operators import chunks
from hostpulse.operators.quantiles import exact_quantiles
from hostpulse.session import materialised

SERIES = ("host", "measurement")


def null_if_not_finite(df: DataFrame, columns: Sequence[str] = ("value",)) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def filled(
    df: DataFrame, columns: Sequence[str] = ("value",), by: Sequence[str] = SERIES, clock: str = "clock",
    rest: float | None = 0.0,
) -> DataFrame:
    """Last known value, else the next known one, else ``rest``.

    A median step in between would never act: a value is still missing after both fills
    only where the whole series is, and then there is no median either.
    """
    near = chunks.with_neighbours(df, by, clock, columns)
    fallback = [] if rest is None else [F.lit(rest)]
    fill = {c: F.coalesce(F.col(f"_prev_{c}.value"), F.col(f"_next_{c}.value"), *fallback) for c in columns}
    return near.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in df.columns])


def carried_forward(
    df: DataFrame, columns: Sequence[str] = ("value",), by: Sequence[str] = SERIES, clock: str = "clock"
) -> DataFrame:
    near = chunks.with_neighbours(df, by, clock, columns)
    return near.select(*[F.col(f"_prev_{c}.value").alias(c) if c in columns else F.col(c) for c in df.columns])


def interpolated(
    df: DataFrame, columns: Sequence[str] = ("value",), by: Sequence[str] = SERIES, clock: str = "clock"
) -> DataFrame:
    """Linear in time between known neighbours; after the last one it stays, before the first it is NULL."""
    near = chunks.with_neighbours(df, by, clock, columns)

    def fill(c: str) -> Column:
        before, after = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        share = (F.col(clock) - before["clock"]) / F.nullif(after["clock"] - before["clock"], F.lit(0))
        between = before["value"] + (after["value"] - before["value"]) * share
        return F.coalesce(F.col(c), F.when(before.isNotNull(), F.coalesce(between, before["value"])))

    return near.select(*[fill(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def missing_share(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(
        (F.count("*") - F.count(value)).alias("missing"), F.count("*").alias("rows")
    ).withColumn("missing_share", F.col("missing") / F.col("rows"))


def dense_series(df: DataFrame, by: Sequence[str] = SERIES, limit: float = fixed.SPARSE_LIMIT) -> DataFrame:
    """Rows of series with less than ``limit`` missing."""
    keep = missing_share(df, by).where(F.col("missing_share") < limit).select(*by)
    return df.join(keep, list(by), "left_semi")


def varying_series(df: DataFrame, by: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Rows of series with more than one distinct value."""
    keep = df.groupBy(*by).agg((F.min(value) != F.max(value)).alias("_varies")).where("_varies").select(*by)
    return df.join(keep, list(by), "left_semi")


def long_enough(df: DataFrame, minimum: int, by: Sequence[str] = SERIES) -> DataFrame:
    """Rows of series with at least ``minimum`` rows."""
    keep = df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).select(*by)
    return df.join(keep, list(by), "left_semi")


def iqr_bounds(df: DataFrame, factor: float, by: Sequence[str] = SERIES, value: str = "value") -> DataFrame:
    """Lower and upper bound per series; the bounds coincide with the quartiles where they meet."""
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    return exact_quantiles(df, by, value, [0.25, 0.75]).select(
        *by, (q1 - (q3 - q1) * factor).alias("lower"), (q3 + (q3 - q1) * factor).alias("upper")
    )


def iqr_capped(
    df: DataFrame, factor: float = fixed.IQR_FACTOR, by: Sequence[str] = SERIES, only_spread: bool = False
) -> DataFrame:
    """Cap values at the band around the quartiles. ``only_spread`` leaves series whose quartiles meet alone."""
    bounds = iqr_bounds(df, factor, by)
    if only_spread:
        bounds = bounds.where(F.col("lower") < F.col("upper"))
    capped = clip(F.col("value"), F.col("lower"), F.col("upper"))
    joined = df.join(bounds, list(by), "left")
    return joined.select(*[capped.alias("value") if c == "value" else F.col(c) for c in df.columns])


def clean(df: DataFrame, by: Sequence[str] = SERIES, clock: str = "clock") -> DataFrame:
    """Fill gaps, then cap outliers at 1.5 times the quartile distance.

    The filled rows are written once: the bounds take two passes over them, capping one more.
    """
    return iqr_capped(materialised(filled(df, by=by, clock=clock, rest=None), "filled"), fixed.IQR_FACTOR, by)


def clean_wide(
    wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("host",), clock: str = "clock"
) -> DataFrame:
    """The same on a wide frame: bounds are fitted per metric and joined as one row per key."""
    full = materialised(filled(wide, columns, by, clock, rest=None), "filled")
    bounds = iqr_bounds(_long(full, columns, by), fixed.IQR_FACTOR, [*by, "measurement"])
    limits = _one_row(bounds, columns, by, ("lower", "upper"))
    return full.join(limits, list(by), "left").select(
        *[
            clip(F.col(c), F.col(f"{c}__lower"), F.col(f"{c}__upper")).alias(c) if c in columns else F.col(c)
            for c in wide.columns
        ]
    )


def prepare_training(
    df: DataFrame, by: Sequence[str] = SERIES, clock: str = "clock", minimum: int = fixed.MIN_DETECTOR_ROWS
) -> DataFrame:
    """Detector training input: drop sparse series, fill, drop constant ones, cap widely, need enough rows."""
    dense = dense_series(null_if_not_finite(df), by)
    varying = materialised(varying_series(filled(dense, by=by, clock=clock), by), "varying")
    return long_enough(iqr_capped(varying, fixed.TRAINING_IQR_FACTOR, by, only_spread=True), minimum, by)


def aligned(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("host", "clock")) -> DataFrame:
    """Exactly the trained features in their order: absent ones 0.0, extra ones dropped, gaps and infinities 0.0."""
    known = set(df.columns)
    return df.select(
        *keys,
        *[
            (F.coalesce(finite(F.col(c)), F.lit(0.0)) if c in known else F.lit(0.0)).alias(c)
            for c in features
        ],
    )


def _long(wide: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    return wide.unpivot(list(by), list(columns), "measurement", "value")


def _one_row(params: DataFrame, columns: Sequence[str], by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Per-metric parameters as one row per key: column ``{metric}__{name}``."""
    return params.groupBy(*by).agg(
        *[
            F.max(F.when(F.col("measurement") == c, F.col(n))).alias(f"{c}__{n}")
            for c in columns
            for n in names
        ]
    )


#: Rounding of sums of doubles, relative to the largest value.
ROUNDING = 2.0**-49


def _scale(scale: Column, low: Column, high: Column) -> Column:
    """A scale, or 1 where it is 0 up to the rounding of values from ``low`` to ``high``."""
    size = F.greatest(F.abs(low.cast("double")), F.abs(high.cast("double")))
    return F.when((low == high) | (scale <= size * ROUNDING), 1.0).otherwise(scale)


def fit_scaling(
    wide: DataFrame, columns: Sequence[str], method: str = "standard", by: Sequence[str] = ("host",)
) -> DataFrame:
    """Centre and scale per key: one row per key with arrays in the order of ``columns``.

    standard: mean and population std; minmax: minimum and range; robust: median and
    quartile distance. A scale that is 0, or within rounding of 0 for values as large as
    the column's, becomes 1; however small, any other scale is used.
    """
    if method == "robust":
        q = F.col("quantiles")
        params = exact_quantiles(_long(wide, columns, by), [*by, "measurement"], "value", [0.25, 0.5, 0.75])
        by_name = params.groupBy(*by).agg(
            F.map_from_entries(
                F.collect_list(F.struct("measurement", F.struct(q[1].alias("center"), _scale(q[2] - q[0], q[0], q[2]).alias("scale"))))
            ).alias("_by_name")
        )
        names = F.array(*[F.lit(c) for c in columns])
        fitted = by_name.select(
            *by,
            F.transform(names, lambda n: F.try_element_at("_by_name", n)["center"]).alias("centers"),
            F.transform(names, lambda n: F.try_element_at("_by_name", n)["scale"]).alias("scales"),
        )
    elif method in ("standard", "minmax"):
        center, scale = {
            "standard": (F.avg, F.stddev_pop),
            "minmax": (F.min, lambda c: F.max(c) - F.min(c)),
        }[method]
        fitted = wide.groupBy(*by).agg(
            F.array(*[center(c).cast("double") for c in columns]).alias("centers"),
            F.array(*[_scale(scale(c).cast("double"), F.min(c), F.max(c)) for c in columns]).alias("scales"),
        )
    else:
        raise ValueError("method must be standard, minmax or robust")
    return fitted


def scaled(wide: DataFrame, columns: Sequence[str], params: DataFrame, by: Sequence[str] = ("host",)) -> DataFrame:
    """Apply fitted scaling."""
    place = {c: i for i, c in enumerate(columns)}
    out = wide.join(params, list(by))
    return out.select(
        *[
            ((F.col(c) - F.get("centers", F.lit(place[c]))) / F.get("scales", F.lit(place[c]))).alias(c)
            if c in place
            else F.col(c)
            for c in wide.columns
        ]
    )


def median_parameters(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("host",)) -> DataFrame:
    medians = exact_quantiles(_long(wide, columns, by), [*by, "measurement"], "value", [0.5]).select(
        *by, "measurement", F.col("quantiles")[0].alias("median")
    )
    return _one_row(medians, columns, by, ("median",))


def median_imputed(wide: DataFrame, columns: Sequence[str], by: Sequence[str] = ("host",)) -> DataFrame:
    return wide.join(median_parameters(wide, columns, by), list(by), "left").select(
        *[F.coalesce(F.col(c), F.col(f"{c}__median")).alias(c) if c in columns else F.col(c) for c in wide.columns]
    )
