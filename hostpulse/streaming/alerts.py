"""A threshold rule that must hold, as one stateful operator of the stream.

Each key's state is where its open run began and when it was last heard of, in the state store. Evaluations of a key are judged in
order of time; one that is older than what was judged before is late and gets no state. A key that stays silent for ``idle`` seconds of
event time is closed by a timer: it gets a ``silent`` row and its state goes, so the store holds living keys only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keeps timers and typed state.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["clock", "value", "state", "since"]


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The session with the state store that the rule needs, for jobs that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def judged(clocks: list[int], values: list[float | None], since: int | None, last: int | None, limit: float, hold: int) -> tuple[list[tuple], int | None, int | None]:
    """(clock, value, state, since) per evaluation that is not late, and what the next batch needs: ``since`` and ``last``."""
    out = []
    for clock, value in sorted(zip(clocks, values), key=lambda e: (e[0], e[1] is not None, e[1] or 0.0)):
        if last is not None and clock < last:
            continue
        high = value is not None and value > limit
        since = (clock if since is None else since) if high else None
        state = "ok" if since is None else "firing" if clock - since >= hold else "pending"
        out.append((clock, value, state, since))
        last = clock
    return out, since, last


class HeldRule(StatefulProcessor):
    """State per key: (since, last). The timer of a key is set anew with each evaluation."""

    def __init__(self, by: str, limit: float, hold: int, idle: int):
        self.by, self.limit, self.hold, self.idle = by, limit, hold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        since = last = None
        if self.run.exists():
            since, last = self.run.get()
        batch = pd.concat(list(rows))
        values = [None if pd.isna(v) else float(v) for v in batch["value"]]
        out, since, last = judged([int(c) for c in batch["clock"]], values, since, last, self.limit, self.hold)
        if last is not None:
            self.run.update((since, last))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.idle) * 1000)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.run.get()[1]
        self.run.clear()
        yield self._frame(key, [(last + self.idle, None, "silent", None)])

    def close(self) -> None:
        pass

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=COLUMNS).astype({"clock": "int64", "value": "float64", "state": "object", "since": "Int64"})
        out.insert(0, self.by, key[0])
        return out


def held_rule(evaluations: DataFrame, limit: float, hold: int, idle: int = 86_400, by: str = "host", delay: str = "10 minutes") -> DataFrame:
    """Stream of (key, clock, value, state, since) from a stream of evaluations (key, clock, value).

    ``state`` is ``ok``, ``pending``, ``firing`` once the value was above ``limit`` at every evaluation for ``hold`` seconds, or
    ``silent`` once for a key that has had none for ``idle`` seconds; the next one begins anew. An unknown value counts as not above. An
    evaluation older than the watermark, or than one of its key that an earlier batch has judged, is dropped. Start it within
    ``state_store``.
    """
    schema = f"{by} {dict(evaluations.dtypes)[by]}, clock bigint, value double, state string, since bigint"
    rows = evaluations.select(by, F.col("clock").cast("long").alias("clock"), F.col("value").cast("double").alias("value"))
    timed = rows.withColumn("event_time", F.timestamp_seconds("clock")).withWatermark("event_time", delay)
    return timed.groupBy(by).transformWithStateInPandas(
        HeldRule(by, limit, hold, idle), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
