"""Incremental export of recent history as JSON events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.functions import text

NEWEST_FLOAT = 5
NEWEST_INTEGER = 3


def active(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == 0)


def with_metadata(history: DataFrame, items: DataFrame, hosts: DataFrame) -> DataFrame:
    """History with its item and host, active ones only.

    No broadcast is forced: the planner broadcasts the item and host tables when their
    measured size allows it and otherwise shuffles, splitting hot items.
    """
    live_items = active(items).select("itemid", "hostid", "key_", F.col("name").alias("item_name"), "units")
    live_hosts = active(hosts).select("hostid", F.col("host").alias("hostname"))
    return history.join(live_items, "itemid").join(live_hosts, "hostid")


def newest(df: DataFrame, n: int, by: str = "hostname") -> DataFrame:
    """The n newest rows per host. The rank limit is applied before the shuffle as well as after."""
    order = Window.partitionBy(by).orderBy(F.col("clock").desc(), F.col("itemid").desc(), F.col("event_id").desc())
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def cleaned(df: DataFrame, table_type: str) -> DataFrame:
    def clean(c: Column) -> Column:
        return text.squeeze(text.plain_text(c))

    return df.select(
        "itemid",
        "clock",
        F.col("value").cast("double").alias("value"),
        "ns",
        clean(F.col("key_")).alias("item_key"),
        clean(F.col("item_name")).alias("item_name"),
        text.squeeze(text.plain_unit(F.col("units"))).alias("units"),
        text.plain_host(F.col("hostname")).alias("hostname"),
        F.lit(table_type).alias("table_type"),
    )


def export_batch(
    history: DataFrame,
    history_uint: DataFrame,
    items: DataFrame,
    hosts: DataFrame,
    as_of: int,
    look_back: int = 300,
    newest_float: int | None = NEWEST_FLOAT,
    newest_integer: int | None = NEWEST_INTEGER,
) -> DataFrame:
    """Recent float and integer samples of active items and hosts.

    The newest-N limits per host are part of the export's definition; None exports all.
    """
    parts = []
    for source, kind, n in ((history, "history", newest_float), (history_uint, "history_uint", newest_integer)):
        recent = with_metadata(source.where(F.col("clock") > as_of - look_back), items, hosts)
        parts.append(cleaned(newest(recent, n) if n else recent, kind))
    return parts[0].unionByName(parts[1])


def json_events(batch: DataFrame, event_type: str, as_of: int) -> DataFrame:
    """One JSON payload per exported sample."""
    payload = F.to_json(
        F.struct(
            F.lit(event_type).alias("type"),
            "itemid", "clock", "value", "ns", "item_key", "item_name", "units", "hostname", "table_type",
            F.lit(as_of).cast("bigint").alias("export_timestamp"),
            F.col("hostname").alias("target_host"),
        )
    )
    return batch.select("itemid", "clock", payload.alias("payload"))
