"""A dated store in which the last write of a key wins.

Each write adds one folder of changes per day it touches; a reader takes the last change of each key. Once a day has more than
``CHANGES`` folders they are merged into one, so files per day stay bounded and a write does not copy the day. A numbered commit
lists the folders of all days; it is put in place by a rename that fails if the number is taken, so a write is visible whole
or not at all, readers keep the state they began with, and of two writers the later one begins again from the other's commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostpulse.operators.dedupe import latest_per_second
from hostpulse.sources import commits

KEYS = ("host", "measurement", "clock")
#: Folders of changes that a day may have.
CHANGES = 8


def _state(spark: SparkSession, path: str) -> dict:
    """The latest commit: number, schema, writers' last batches, and (date, order, folder) of all days."""
    names = commits.listed(spark, f"{path}/commits")
    if not names:
        return {"number": 0, "schema": None, "writers": {}, "folders": []}
    return json.loads(spark.read.text(f"{path}/commits/{names[-1]}", wholetext=True).first()[0])


def _written(points: DataFrame, path: str) -> tuple[str, list[str]]:
    """Write points by date into a fresh folder; its name and the dates in it."""
    name = f"w{uuid.uuid4().hex}"
    points.hint("rebalance", "date").write.partitionBy("date").parquet(f"{path}/data/folder={name}")
    found = commits.listed(points.sparkSession, f"{path}/data/folder={name}")
    return name, [n.split("=", 1)[1] for n in found if n.startswith("date=")]


def _latest(spark: SparkSession, path: str, schema: StructType, folders: list[list], keys: Sequence[str]) -> DataFrame:
    """The last change of each key in the listed folders; days of one folder are read as they are."""
    per_day: dict[str, int] = {}
    for date, _, _ in folders:
        per_day[date] = per_day.get(date, 0) + 1
    whole = StructType([*schema.fields]).add("folder", "string").add("date", "date")

    def scan(rows: list[list]) -> DataFrame:
        places = [f"{path}/data/folder={folder}/date={date}" for date, _, folder in rows]
        return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*places)

    out = spark.createDataFrame([], whole).drop("folder")
    if single := [r for r in folders if per_day[r[0]] == 1]:
        out = scan(single).drop("folder")
    if many := [r for r in folders if per_day[r[0]] > 1]:
        # At most CHANGES + 1 rows a day.
        orders = spark.createDataFrame(sorted({(folder, order) for _, order, folder in many}), "folder string, _order long")
        changes = scan(many).join(F.broadcast(orders), "folder").drop("folder")
        out = out.unionByName(latest_per_second(changes, "_order", [*keys, "date"]).drop("_order").select(*out.columns))
    return out


def upsert(
    points: DataFrame, path: str, order: str, keys: Sequence[str] = KEYS, writer: str = "writer", batch: int | None = None,
    changes: int = CHANGES,
) -> bool:
    """Write points (with ``clock``, an epoch second) over what the store has of their keys; False if this batch was written before.

    Within the call the row with the greatest ``order`` stays, a null one being the least. A batch of a writer is known by its
    number, which must rise; without a number every call is new. Points without a clock are kept under a day of their own.
    """
    spark, path = points.sparkSession, path.rstrip("/")
    state = _state(spark, path)
    if batch is not None and state["writers"].get(writer, -1) >= batch:
        return False
    ranked = points.withColumn("_rank", F.struct(F.col(order).isNotNull(), F.col(order)))
    last = latest_per_second(ranked, "_rank", keys).drop("_rank").select(*points.columns)
    schema = last.schema
    folder, days = _written(last.withColumn("date", F.to_date(F.timestamp_seconds("clock"))), path)
    while True:
        number = state["number"] + 1
        folders = [*state["folders"], *[[day, number, folder] for day in days]]
        crowded = {day for day in days if sum(f[0] == day for f in folders) > changes}
        merged = None
        if crowded:
            old = [f for f in folders if f[0] in crowded]
            merged, merged_days = _written(_latest(spark, path, schema, old, keys), path)
            folders = [f for f in folders if f[0] not in crowded] + [[day, number, merged] for day in merged_days]
        writers = {**state["writers"], **({writer: batch} if batch is not None else {})}
        document = {"number": number, "schema": schema.json(), "writers": writers, "folders": folders}
        if commits.put_once(spark, f"{path}/commits/{number:020d}.json", json.dumps(document)):
            return True
        if merged is not None:
            commits.removed(spark, f"{path}/data/folder={merged}")
        state = _state(spark, path)
        if batch is not None and state["writers"].get(writer, -1) >= batch:  # by another run of this batch
            commits.removed(spark, f"{path}/data/folder={folder}")
            return False


def read(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """The store as of its latest commit, one row per key, with ``date``; of the days from ``first`` to ``last`` only, where named."""
    path = path.rstrip("/")
    state = _state(spark, path)
    if state["schema"] is None:
        raise ValueError(f"no committed write in {path}")
    folders = [f for f in state["folders"] if (first is None or f[0] >= first) and (last is None or f[0] <= last)]
    return _latest(spark, path, StructType.fromJson(json.loads(state["schema"])), folders, keys)


def vacuum(spark: SparkSession, path: str, keep: int = 10) -> int:
    """Remove the folders that none of the last ``keep`` commits list, and older commits; how many folders went.

    Not to be run beside a writer: what it has written but not committed would go.
    """
    path = path.rstrip("/")
    names = commits.listed(spark, f"{path}/commits")
    used = set()
    for name in names[-keep:]:
        document = json.loads(spark.read.text(f"{path}/commits/{name}", wholetext=True).first()[0])
        used |= {f"folder={folder}" for _, _, folder in document["folders"]}
    for name in names[:-keep]:
        commits.removed(spark, f"{path}/commits/{name}")
    stale = [n for n in commits.listed(spark, f"{path}/data") if n not in used]
    for name in stale:
        commits.removed(spark, f"{path}/data/{name}")
    return len(stale)
