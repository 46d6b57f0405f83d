"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.session import materialised, prepare

#: A word is a run of characters other than space and tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"


#: Seconds that listeners and executors get to let go of a finished step's shuffle files.
RELEASE_S = 0.3
#: Bytes of text that a task turns into Python objects at a time.
PIECE = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table. Settings that results depend on are pinned on the way."""
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``materialised``, after which the shuffle files of the steps up to here may go.

    Spark deletes them once the driver's garbage collectors find that nothing refers to them any more, which may be long after; here a
    step is as large as the corpus, so they are asked to look.
    """
    out = materialised(df, purpose)
    for _ in range(2):  # what the listeners still hold at first goes the second time
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(RELEASE_S)
    return out


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet, compared without case as Spark does."""
    taken, name, k = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def text_bytes(column: str = "text"):
    """UTF-8 length of a text, 0 for null."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of an Arrow batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str, budget: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with at most ``budget`` bytes in ``column``, one row at least."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        for i, j in slices([max(64, n) for n in sizes], budget):
            yield b.slice(i, j - i)


def extended(batch: pa.RecordBatch, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The columns ``names`` of a batch as they are, and new ones."""
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *new.values()], names=[*names, *new])


def slices(lengths: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive runs [a, b) of rows with at most ``budget`` bytes, one row at least."""
    a = total = 0
    for b, n in enumerate(lengths):
        if b > a and total + n > budget:
            yield a, b
            a, total = b, 0
        total += n
    if a < len(lengths):
        yield a, len(lengths)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads polynomial hashes over all bits."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))
