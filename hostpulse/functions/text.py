"""Cleaning of item keys, host names, units and exported text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def measurement_name(key: Column) -> Column:
    """Item key to a measurement name; a missing key becomes a placeholder name.

    Bad characters become underscores, of which runs become one and outer ones none: one pattern for both.
    """
    name = F.btrim(F.regexp_replace(key, fixed.BETWEEN_NAME_PARTS, "_"), F.lit("_"))
    return F.when(_present(key), name).otherwise(F.lit(fixed.UNKNOWN_MEASUREMENT))


def host_tag(host: Column) -> Column:
    return F.regexp_replace(host, fixed.BAD_HOST_CHARACTER, "_")


def unit_tag(unit: Column) -> Column:
    cleaned = F.regexp_replace(unit, fixed.BAD_UNIT_CHARACTER, "_")
    return F.when(_present(unit), cleaned).otherwise(F.lit(fixed.NO_UNIT))


def plain_text(c: Column) -> Column:
    """Drop double quotes; line breaks and tabs become spaces."""
    return F.translate(c, '\n\r\t"', "   ")


def plain_unit(c: Column) -> Column:
    return F.coalesce(F.nullif(plain_text(c), F.lit("")), F.lit(fixed.NO_UNIT))


def plain_host(c: Column) -> Column:
    return F.translate(c, ' "', "_")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))
