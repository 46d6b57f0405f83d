"""One row per series and time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one_per_key(df: DataFrame, keys: Sequence[str], order: str, keep: str) -> DataFrame:
    """Partial aggregation shrinks a hot key's copies before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_row")).select(
        *keys, *[F.col(f"_row.{c}").alias(c) for c in rest]
    )


def latest_per_second(samples: DataFrame, order: str, keys: Sequence[str] = ("host", "measurement", "clock")) -> DataFrame:
    """The store's rule: a series has one sample per second and the last written wins."""
    return _one_per_key(samples, keys, order, keep="last")


def first_per_time(samples: DataFrame, order: str, keys: Sequence[str] = ("host", "measurement", "clock")) -> DataFrame:
    """Keep the first of several samples of one time."""
    return _one_per_key(samples, keys, order, keep="first")
