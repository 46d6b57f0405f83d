"""JSON events to typed, named and routed samples; the same columns serve batch and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.functions import text
from hostpulse.session import computed_once

EVENT_SCHEMA = (
    "type string, itemid string, clock string, value string, ns string, item_key string, item_name string, "
    "units string, hostname string, table_type string, export_timestamp string, target_host string, _broken string"
)
STORED, INVALID, BROKEN, OTHER = "stored", "invalid", "broken", "dropped"


def parse_events(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse JSON lines. A line that is not JSON keeps its text in ``_broken``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    return computed_once(lines, F.from_json(raw, EVENT_SCHEMA, options), "_e").select(
        *[c for c in lines.columns if c != raw], "_e.*"
    )


def _typed_value() -> Column:
    """Float tables keep the fraction, integer tables drop it; both are stored as doubles."""
    number = F.expr("try_cast(value AS DOUBLE)")
    return F.when(F.col("table_type") == "history", number).when(
        F.col("table_type") == "history_uint", F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double")
    )


def route_events(parsed: DataFrame) -> DataFrame:
    """Add type, name and tag columns and the ``route`` each event takes.

    An event without item, time or value is invalid, and so is one whose time is no integer or
    whose value, in a numeric table, is no finite number; the tag tells the two apart.
    """
    broken = F.col("_broken").isNotNull()
    missing = F.col("itemid").isNull() | F.col("clock").isNull() | F.col("value").isNull()
    numeric = F.col("table_type").isin("history", "history_uint")
    number = F.expr("try_cast(value AS DOUBLE)")
    unparsable = F.expr("try_cast(clock AS BIGINT)").isNull() | (
        numeric & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))
    )
    invalid = missing | unparsable
    usable = ~broken & ~invalid
    return parsed.select(
        *[c for c in parsed.columns if c not in ("value", "clock", "ns", "itemid")],
        F.col("itemid").alias("item_id"),
        F.expr("try_cast(clock AS BIGINT)").alias("clock"),
        F.expr("try_cast(ns AS BIGINT)").alias("ns"),
        F.when(usable, _typed_value()).alias("value"),
        F.when(broken, fixed.PARSE_ERROR_MEASUREMENT)
        .when(invalid, fixed.INVALID_MEASUREMENT)
        .otherwise(text.measurement_name(F.col("item_key")))
        .alias("measurement"),
        F.when(broken, fixed.PARSE_ERROR_TYPE).alias("error_type"),
        F.when(~broken & missing, fixed.MISSING_FIELDS_TAG)
        .when(~broken & unparsable, fixed.UNPARSABLE_FIELDS_TAG)
        .alias("tag"),
        F.when(usable & numeric, "numeric").alias("data_type"),
        F.when(usable & (F.col("table_type") == "history"), "float")
        .when(usable & (F.col("table_type") == "history_uint"), "integer")
        .alias("value_category"),
        text.host_tag(F.col("hostname")).alias("host"),
        text.unit_tag(F.col("units")).alias("unit"),
        F.when(broken, BROKEN).when(invalid, INVALID).when(numeric, STORED).otherwise(OTHER).alias("route"),
    )


def stored_points(routed: DataFrame) -> DataFrame:
    """The points that reach the store."""
    return routed.where(F.col("route") == STORED).select(
        "measurement", "host", "item_id", "data_type", "unit", "value", "clock"
    )


def quarantined(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("route") != STORED)


def line_protocol(points: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One text line per point: name and tags, the value field, the epoch second. ``keep`` names columns to carry along."""
    tags = F.concat_ws(
        ",",
        F.col("measurement"),
        F.concat(F.lit("host="), F.col("host")),
        F.concat(F.lit("item_id="), F.col("item_id")),
        F.concat(F.lit("data_type="), F.col("data_type")),
        F.concat(F.lit("unit="), F.col("unit")),
    )
    field = F.concat(F.lit("value="), F.col("value").cast("string"))
    return points.select(F.concat_ws(" ", tags, field, F.col("clock").cast("string")).alias("line"), *keep)


def write_lines(points: DataFrame, path: str, batch: str = "0") -> None:
    """Write lines to the folder of their batch. A batch that is written again replaces itself."""
    line_protocol(points).withColumnRenamed("line", "value").write.mode("overwrite").text(f"{path}/batch={batch}")


def write_store(points: DataFrame, path: str, batch: str = "0") -> None:
    """Add points to the columnar store, one folder per day and batch.

    Tasks are cut by size, days kept together, so neither a busy day lands in one task nor a
    quiet one in many. A batch that is written again replaces itself and nothing else.
    """
    dated = points.withColumn("date", F.to_date(F.timestamp_seconds("clock"))).withColumn("batch", F.lit(batch))
    dated.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "date", "batch"
    ).parquet(path)
