"""Structured Streaming jobs built from the same column functions as the batch jobs.

Every job takes a trigger: ``availableNow`` to catch up and stop, or a processing time to
run on. State and progress live in the checkpoint folder, so a lost executor or driver
resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hostpulse.operators import baseline as detectors
from hostpulse.operators.aggregates import _aggregate, window_seconds
from hostpulse.operators.indicators import alert_state
from hostpulse.sources import ingest
from hostpulse.sources import upserts as upserting

AVAILABLE_NOW = {"availableNow": True}
EVERY_MINUTE = {"processingTime": "60 seconds"}


def json_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of JSON text files, one event per line, in column ``raw``."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).withColumnRenamed("value", "raw")


def table_stream(spark: SparkSession, folder: str, name: str, max_files: int | None = None) -> DataFrame:
    """Stream of a parquet table's files: of the table's folder, or of a table that is one file."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def with_event_time(points: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Event time from the epoch second, and how late a sample may come."""
    return points.withColumn("event_time", F.timestamp_seconds("clock")).withWatermark("event_time", delay)


def routed(lines: DataFrame) -> DataFrame:
    """Parse, type, name and route."""
    return ingest.route_events(ingest.parse_events(lines))


def deduplicated(points: DataFrame, delay: str = "10 minutes", keys: Sequence[str] = ("host", "item_id", "clock")) -> DataFrame:
    """Drop samples that overlapping exports delivered again. State is kept for ``delay`` only.

    The first delivery stays, while the store's own rule keeps the last: replays are taken to be
    identical. Where they are not, write with ``upserts``.
    """
    return with_event_time(points, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed(
    points: DataFrame, window: str = "1h", aggregation: str = "mean", delay: str = "10 minutes",
    by: Sequence[str] = ("host", "measurement"),
) -> DataFrame:
    """Tumbling aggregate per series, emitted once its window can no longer change."""
    span = F.window("event_time", f"{window_seconds(window)} seconds")
    return (
        with_event_time(points, delay)
        .groupBy(*by, span.alias("_w"))
        .agg(_aggregate(aggregation).alias("value"))
        .select(
            *by,
            F.unix_seconds("_w.start").alias("window_start"),
            F.unix_seconds("_w.end").alias("window_end"),
            "value",
        )
    )


def scored(points: DataFrame, fitted: DataFrame) -> DataFrame:
    """Each sample's detector flags against a stored baseline: a stream-static join."""
    return detectors.compared(points, fitted)


def write_files(stream: DataFrame, path: str, checkpoint: str, trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def write_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict = AVAILABLE_NOW,
    mode: str = "append",
) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def split_routes(stored_path: str, quarantine_path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: points to the dated store that ``scan_history`` reads, all else to a table of its own.

    A repeated batch overwrites itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            ingest.write_store(ingest.stored_points(kept), stored_path, str(batch_id))
            ingest.quarantined(kept).write.mode("overwrite").parquet(f"{quarantine_path}/batch={batch_id}")
        finally:
            kept.unpersist()

    return write


def upserts(path: str, order: str, keys: Sequence[str] = upserting.KEYS, writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """Batch writer by the store's overwrite rule: of a key the last delivery stays, within a batch by ``order``. A repeated
    batch changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upserting.upsert(batch, path, order, keys, writer, batch_id)

    return write


def alert_states(
    spark: SparkSession, carried_path: str, out_path: str, limit: float, hold: int, by: str = "host"
) -> Callable[[DataFrame, int], None]:
    """Batch writer for a threshold rule that must hold. Input: key, clock, value per evaluation.

    What one batch leaves to the next is, per key, where its open run began: one small row.
    It enters the next batch as an evaluation at that time. Each batch writes its states
    and its open runs under its number, so a repeated batch overwrites itself.
    """
    schema = f"{by} string, since bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        before = (
            spark.read.schema(schema).parquet(f"{carried_path}/batch={batch_id - 1}")
            if batch_id
            else spark.createDataFrame([], schema)
        )
        opened = before.where(F.col("since").isNotNull()).select(
            by, F.col("since").alias("clock"), F.lit(limit + 1.0).alias("value"), F.lit(1).alias("_carried")
        )
        rows = batch.select(by, "clock", "value", F.lit(0).alias("_carried")).unionByName(opened)
        states = alert_state(rows, limit, hold, (by,)).where(F.col("_carried") == 0).drop("_carried").persist()
        try:
            states.drop("since").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            latest = states.groupBy(by).agg(F.max_by("since", "clock").alias("since"))
            left = before.join(latest, by, "left_anti")
            latest.unionByName(left).write.mode("overwrite").parquet(f"{carried_path}/batch={batch_id}")
        finally:
            states.unpersist()

    return write


def finished(query: StreamingQuery) -> None:
    """Wait for a catch-up run to end; its error is raised here."""
    query.awaitTermination()
