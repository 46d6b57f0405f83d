"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import hostpulse
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "hostpulse", master: str | None = None, **conf: object) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on. Cluster sizing is left to the cluster.

    Functions that run in tasks travel with the job, so executors need no copy of this package.
    """
    cloudpickle.register_pickle_by_value(hostpulse)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, a laptop) a temporary folder is made and removed again at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return f"{root.rstrip('/')}/hostpulse/{purpose}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    root = tempfile.mkdtemp(prefix="hostpulse-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    return os.path.join(root, purpose)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by the keys into the session's full number of partitions.

    For work in Python tasks that is heavy in time but light in bytes: left alone, adaptive
    execution would merge such partitions into a few. A grouping by the same keys follows
    without another shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def computed_once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Add a costly column that filters and columns on top of it read instead of computing it again.

    The optimizer moves a filter below the projection that it reads from and writes the expression out in both, and takes
    parsed JSON apart into a parse per field. It leaves the rows of a generator alone.
    """
    return df.select("*", F.explode(F.array(column)).alias(name))


def materialised(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame that several later passes read, and read it back.

    The table lies in the shared folder, so lost executors cost no recomputation of what
    led to it, and each later pass reads only the columns it needs.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
