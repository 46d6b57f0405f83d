"""Null, NaN, clipping and ratio rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def zero_if_not_finite(c: Column) -> Column:
    """NaN, infinities and NULL become 0.0 at an output edge."""
    return F.coalesce(finite(c), F.lit(0.0))


def clean_map(c: Column) -> Column:
    return F.transform_values(c, lambda _, v: zero_if_not_finite(v))


def clean_array(c: Column) -> Column:
    return F.transform(c, zero_if_not_finite)


def clip(c: Column, lower: Column, upper: Column) -> Column:
    """Bound a value. NULL stays NULL, and a NULL bound does not bind."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, lower), upper))


def clip_percentage(c: Column) -> Column:
    return clip(c, F.lit(0.0), F.lit(100.0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b + F.lit(fixed.RATIO_FLOOR))


def floored_spread(c: Column) -> Column:
    """A spread usable as a divisor: missing, NaN or zero becomes a tiny value."""
    return F.when(c.isNull() | F.isnan(c) | (c == 0), F.lit(fixed.SPREAD_FLOOR)).otherwise(c)
