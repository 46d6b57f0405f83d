"""Calendar features of an epoch-second column (UTC session, Monday is 0)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hour(clock: Column) -> Column:
    return F.hour(F.timestamp_seconds(clock))


def weekday(clock: Column) -> Column:
    return F.weekday(F.timestamp_seconds(clock))


def is_weekend(clock: Column) -> Column:
    return (weekday(clock) >= 5).cast("int")


def is_business_hour(clock: Column) -> Column:
    """Nine to five inclusive on Monday to Friday."""
    return (hour(clock).between(9, 17) & (weekday(clock) < 5)).cast("int")


def simple_features(clock: Column) -> list[Column]:
    return [
        hour(clock).alias("hour"),
        weekday(clock).alias("day_of_week"),
        is_weekend(clock).alias("is_weekend"),
    ]


def calendar_features(clock: Column, hour_name: str = "hour") -> list[Column]:
    return [
        hour(clock).alias(hour_name),
        weekday(clock).alias("day_of_week"),
        is_weekend(clock).alias("is_weekend"),
        is_business_hour(clock).alias("is_business_hours"),
    ]


def cyclic_features(clock: Column) -> list[Column]:
    day = F.lit(2 * math.pi) * hour(clock) / F.lit(24)
    week = F.lit(2 * math.pi) * weekday(clock) / F.lit(7)
    return [
        F.sin(day).alias("hour_sin"),
        F.cos(day).alias("hour_cos"),
        F.sin(week).alias("day_sin"),
        F.cos(week).alias("day_cos"),
    ]
