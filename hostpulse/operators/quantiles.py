"""Exact quantiles per key when one key may hold a third of all rows.

The built-in exact ``percentile`` keeps every distinct value of a key in one buffer. Here
a mergeable sketch first brackets each wanted rank of a large key. Values outside the
brackets are then replaced by one stand-in per gap between them, which changes no wanted
rank, and the exact ``percentile`` runs over what is left: the values inside the brackets
and a few stand-ins, counted by partial aggregation before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_ACCURACY = 100_000
# The sketch errs by at most 1 / SKETCH_ACCURACY of the ranks; brackets reach four times as far.
_MARGIN = 4.0 / SKETCH_ACCURACY
# Keys up to this size keep all values; for larger ones the margin is four ranks or more.
_SMALL = SKETCH_ACCURACY


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: Column | str,
    probabilities: Sequence[float],
    output: str = "quantiles",
    also: Sequence[Column] = (),
) -> DataFrame:
    """One row per key: array ``output`` of linearly interpolated quantiles (NULLs ignored).

    ``also`` are further aggregates over ``df``'s columns, taken in the same first pass.
    Keys without any value have a row only if ``also`` is given.
    """
    by = list(by)
    v = F.col(value) if isinstance(value, str) else value
    wanted = sorted(set(probabilities))
    bounds = [x for p in wanted for x in (max(0.0, p - _MARGIN), min(1.0, p + _MARGIN))]

    counted = df.groupBy(*by).agg(F.count(v).alias("_n"), *also)
    extra = [c for c in counted.columns if c not in by and c != "_n"]
    rows = df.select(*by, v.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # Only rows of large keys are sketched.
    large = counted.where(F.col("_n") > _SMALL).select(*by)
    sketched = _join_by(rows, large, by).groupBy(*by).agg(
        F.percentile_approx("_v", bounds, SKETCH_ACCURACY).alias("_bounds")
    )

    # Walk the brackets upwards: the first one whose upper end reaches the value either holds it or has it below.
    kept: Column = F.when(F.col("_bounds").isNull(), F.col("_v"))
    for i in range(len(wanted)):
        low, high = F.get("_bounds", F.lit(2 * i)), F.get("_bounds", F.lit(2 * i + 1))
        before = F.get("_bounds", F.lit(2 * i - 1)) if i else low - F.abs(low) - 1.0
        kept = kept.when((F.col("_v") >= low) & (F.col("_v") <= high), F.col("_v"))
        kept = kept.when(F.col("_v") < low, before + (low - before) / 2)
    top = F.get("_bounds", F.lit(2 * len(wanted) - 1))
    kept = kept.otherwise(top + F.abs(top) + 1.0)

    exact = (
        _join_by(rows, sketched, by, how="left")
        .select(*by, kept.alias("_x"))
        .groupBy(*by)
        .agg(F.percentile("_x", list(probabilities)).alias(output))
    )
    if not extra:
        return exact if by else exact.where(F.col(output).isNotNull())
    return _join_by(counted.drop("_n"), exact, by, how="left")


def _join_by(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on the keys; without keys ``right`` is the single row of a global aggregate."""
    if by:
        return left.join(right, by, how)
    one = F.lit(1).alias("_one")
    return left.select("*", one).join(F.broadcast(right.select("*", one)), ["_one"], how).drop("_one")
