"""Commits of whole model versions: a version exists from the moment its manifest does.

A saver writes all tables of a model into a folder of its own, which nobody reads, and then puts one manifest in place by a
rename that fails if the name is taken. Readers go by manifests alone, so a save that was cut off stays invisible and
of two savers of one version one wins whole.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.functions import fixed_values as fixed
from hostpulse.sources.registry import version_order

MANIFEST = (
    "model_name string, version string, training_samples long, features array<string>, metrics array<string>, folder string"
)


class VersionExists(ValueError):
    """The version was committed before, by this saver or another."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(root: str, kind: str) -> str:
    return f"{root.rstrip('/')}/commits/{kind}"


def put_once(spark: SparkSession, path: str, content: str) -> bool:
    """Put a file in place whole, unless one is there: then False. It is written under a hidden name and renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    final = _path(spark, path)
    draft = _path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    files = final.getFileSystem(conf)
    out = files.create(draft, False)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    no_overwrite = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(draft, final, no_overwrite)
    except Py4JJavaError as failure:
        files.delete(draft, False)
        if "FileAlreadyExistsException" not in failure.java_exception.getClass().getName():
            raise
        return False
    return True


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, hidden ones left out; none where there is no folder."""
    files, place = _system(spark, path), _path(spark, path)
    if not files.exists(place):
        return []
    return sorted(n for s in files.listStatus(place) if (n := s.getPath().getName())[0] not in "._")


def removed(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def attempt(kind: str) -> str:
    """A fresh folder for one save, relative to the root."""
    return f"{kind}/{uuid.uuid4().hex}"


def commit(
    spark: SparkSession, root: str, kind: str, version: str, folder: str, training: int,
    features: Sequence[str] | None = None, metrics: Sequence[str] | None = None, backups: int = fixed.MODEL_BACKUPS,
) -> None:
    """Make what lies in ``folder`` (of ``root``) the version of this kind, then drop all but it and ``backups`` older ones.

    Raises VersionExists, and removes ``folder``, if the version is there already; the committed one stays as it is.
    """
    line = json.dumps({
        "model_name": kind, "version": version, "training_samples": training, "folder": folder,
        "features": None if features is None else list(features), "metrics": None if metrics is None else list(metrics),
    })
    if not put_once(spark, f"{_manifests(root, kind)}/{quote(version, safe='')}.json", line):
        _system(spark, root).delete(_path(spark, f"{root}/{folder}"), True)
        raise VersionExists(f"{kind} {version} is committed already")
    retain(spark, root, kind, backups)


def committed(spark: SparkSession, root: str, kinds: Sequence[str]) -> DataFrame:
    """One row for each committed version of the kinds."""
    return spark.read.schema(MANIFEST).json([_manifests(root, k) for k in kinds])


def manifest(spark: SparkSession, root: str, kind: str, version: str | None = None):
    """The manifest of a version, of the latest when none is named."""
    rows = committed(spark, root, [kind])
    if version is not None:
        rows = rows.where(F.col("version") == version)
    found = rows.orderBy(version_order(F.col("version")).desc()).first()
    if found is None:
        raise ValueError(f"no committed version {version or ''} of {kind}")
    return found


def retain(spark: SparkSession, root: str, kind: str, backups: int = fixed.MODEL_BACKUPS) -> list[str]:
    """Drop versions older than the latest and its ``backups``; their names. The manifest goes first, then the tables."""
    # As many rows as versions are kept, and those committed since.
    rows = committed(spark, root, [kind]).orderBy(version_order(F.col("version")).desc()).collect()
    files = _system(spark, root)
    for row in rows[backups + 1 :]:
        files.delete(_path(spark, f"{_manifests(root, kind)}/{quote(row.version, safe='')}.json"), False)
        files.delete(_path(spark, f"{root}/{row.folder}"), True)
    return [row.version for row in rows[backups + 1 :]]


def sweep(spark: SparkSession, root: str, kind: str, hours: float = 24.0) -> int:
    """Remove folders of saves that were never committed and are older than ``hours``; how many."""
    known = {row.folder for row in committed(spark, root, [kind]).select("folder").collect()}
    files = _system(spark, root)
    gone = 0
    for status in files.listStatus(_path(spark, f"{root.rstrip('/')}/{kind}")):
        name = f"{kind}/{status.getPath().getName()}"
        if name not in known and status.getModificationTime() <= (time.time() - hours * 3600) * 1000:
            gone += bool(files.delete(status.getPath(), True))
    return gone
