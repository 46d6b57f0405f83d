"""Rolling, lag, change, position and trend operators over series of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostpulse.functions import fixed_values as fixed
from hostpulse.operators import chunks, rolling

SERIES = ("host", "measurement")
#: Chunks of rolling windows in time: tasks share the work of a series, and few rows are copied.
ROLLING_CHUNK_SECONDS = 24 * 3600


def _four(c: str, frame: WindowSpec, suffix: str, std_fill: float | None = None) -> list[Column]:
    # Equal values have a deviation of exactly 0; the running formula may leave rounding noise.
    std = F.stddev_samp(c).over(frame)
    std = F.when(std.isNotNull() & (F.min(c).over(frame) == F.max(c).over(frame)), 0.0).otherwise(std)
    if std_fill is not None:
        std = F.coalesce(std, F.lit(std_fill))
    return [
        F.avg(c).over(frame).alias(f"{c}_rolling_mean_{suffix}"),
        std.alias(f"{c}_rolling_std_{suffix}"),
        F.max(c).over(frame).alias(f"{c}_rolling_max_{suffix}"),
        F.min(c).over(frame).alias(f"{c}_rolling_min_{suffix}"),
    ]


def row_rolling_columns(window: WindowSpec, c: str, rows: Sequence[int]) -> list[Column]:
    """The same over the last n rows; a missing std is 0."""
    return [x for n in rows for x in _four(c, window.rowsBetween(-(n - 1), 0), str(n), std_fill=0.0)]


def lag_columns(window: WindowSpec, c: str, periods: Sequence[int]) -> list[Column]:
    return [F.lag(c, n).over(window).alias(f"{c}_lag_{n}") for n in periods]


def filled_lag_columns(window: WindowSpec, c: str, periods: Sequence[int], first: Column) -> list[Column]:
    """Lags whose gaps take the series' first value."""
    return [F.coalesce(F.lag(c, n).over(window), first).alias(f"{c}_lag_{n}") for n in periods]


def change_columns(window: WindowSpec, c: str, ratio_name: str, fill: float | None = None) -> list[Column]:
    """Relative and absolute change to the previous row; optionally filled."""
    previous = F.lag(c, 1).over(window)
    relative, absolute = F.try_divide(F.col(c), previous) - 1, F.col(c) - previous
    if fill is not None:
        relative, absolute = F.coalesce(relative, F.lit(fill)), F.coalesce(absolute, F.lit(fill))
    return [relative.alias(f"{c}_{ratio_name}"), absolute.alias(f"{c}_diff")]


def _with(df: DataFrame, columns: list[Column]) -> DataFrame:
    return df.select("*", *columns)


def rolling_by_time(
    df: DataFrame, columns: Sequence[str] = ("value",), minutes: Sequence[int] = fixed.ROLLING_MINUTES,
    by: Sequence[str] = SERIES, clock: str = "clock",
) -> DataFrame:
    """Mean, std, max and min over ``(t - w, t]``; the std of a single row is NULL.

    A range frame of the engine adds up every row's window anew. Here a task's sorted rows pass in batches, and every window is put
    together from runs of 1, 2, 4, ... rows, so a row costs the logarithm of its window's rows. Rows of one series and time
    meet in one batch.
    """
    span = max(minutes) * 60
    types = dict(df.dtypes)
    reach = chunks.halo(df, by, clock, look_back=span - 1, seconds=max(min(ROLLING_CHUNK_SECONDS, chunks.CHUNK_SECONDS), span))
    keys = [*by, chunks.CHUNK]
    rows = reach.repartition(*keys).sortWithinPartitions(*keys, clock)
    whole = {c for c in columns if types[c] in ("tinyint", "smallint", "int", "bigint")}
    made = [(c, m, s) for c in columns for m in minutes for s in ("mean", "std", "max", "min")]
    names = [f"{c}_rolling_{s}_{m}m" for c, m, s in made]
    kinds = ["bigint" if c in whole and s in ("max", "min") else "double" for c, _, s in made]
    schema = T.StructType(
        [*reach.schema.fields, *[T.StructField(n, T.LongType() if k == "bigint" else T.DoubleType()) for n, k in zip(names, kinds)]]
    )
    out = rows.mapInArrow(rolling.time_windows(keys, clock, columns, [m * 60 for m in minutes], whole, names), schema)
    typed = [F.col(n).cast(types[c]).alias(n) if c in whole and s in ("max", "min") else F.col(n) for n, (c, _, s) in zip(names, made)]
    return chunks.without_halo(out).select(*[F.col(f"`{c}`") for c in df.columns], *typed)


def rolling_by_rows(
    df: DataFrame, columns: Sequence[str] = ("value",), rows: Sequence[int] = fixed.ROLLING_ROWS,
    by: Sequence[str] = SERIES, clock: str = "clock",
) -> DataFrame:
    w = chunks.chunk_window(by, clock)
    out = _with(
        chunks.halo(df, by, clock, before=max(rows) - 1),
        [x for c in columns for x in row_rolling_columns(w, c, rows)],
    )
    return chunks.without_halo(out)


def lagged(
    df: DataFrame, columns: Sequence[str] = ("value",), periods: Sequence[int] = fixed.LAG_PERIODS,
    by: Sequence[str] = SERIES, clock: str = "clock",
) -> DataFrame:
    w = chunks.chunk_window(by, clock)
    out = _with(
        chunks.halo(df, by, clock, before=max(periods)), [x for c in columns for x in lag_columns(w, c, periods)]
    )
    return chunks.without_halo(out)


def lagged_filled(
    df: DataFrame, columns: Sequence[str] = ("value",), periods: Sequence[int] = fixed.FILLED_LAG_PERIODS,
    by: Sequence[str] = SERIES, clock: str = "clock",
) -> DataFrame:
    first = df.groupBy(*by).agg(*[F.min_by(c, clock).alias(f"_first_{c}") for c in columns])
    w = chunks.chunk_window(by, clock)
    out = _with(
        chunks.halo(df, by, clock, before=max(periods)).join(first, list(by)),
        [x for c in columns for x in filled_lag_columns(w, c, periods, F.col(f"_first_{c}"))],
    )
    return chunks.without_halo(out).drop(*[f"_first_{c}" for c in columns])


def changed(
    df: DataFrame, columns: Sequence[str] = ("value",), ratio_name: str = "rate_change", fill: float | None = None,
    by: Sequence[str] = SERIES, clock: str = "clock",
) -> DataFrame:
    w = chunks.chunk_window(by, clock)
    out = _with(
        chunks.halo(df, by, clock, before=1), [x for c in columns for x in change_columns(w, c, ratio_name, fill)]
    )
    return chunks.without_halo(out)


def smoothed(df: DataFrame, value: str = "value", by: Sequence[str] = SERIES, clock: str = "clock") -> DataFrame:
    """Replace each value by the median of itself and its two neighbours; NULLs do not count."""
    w = chunks.chunk_window(by, clock)
    near = F.sort_array(F.array_compact(F.array(F.lag(value, 1).over(w), F.col(value), F.lead(value, 1).over(w))))
    marked = chunks.halo(df, by, clock, before=1, after=1).withColumn("_near", near)
    n = F.size("_near")
    middle = (F.get("_near", F.floor((n - 1) / 2).cast("int")) + F.get("_near", F.floor(n / 2).cast("int"))) / 2
    return chunks.without_halo(marked.withColumn(value, middle).drop("_near"))


def standardised(
    df: DataFrame, columns: Sequence[str] = ("value",), by: Sequence[str] = SERIES
) -> DataFrame:
    """Whole-series z-score per column; 0 where the series does not vary."""
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_std_{c}") for c in columns]
    )
    return df.join(stats, list(by)).select(
        *df.columns, *[zscore(c, F.col(f"_mean_{c}"), F.col(f"_std_{c}")).alias(f"{c}_zscore") for c in columns]
    )


def zscore(c: str, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (F.col(c) - mean) / std).otherwise(F.lit(0.0))


def split_by_time(
    df: DataFrame, by: Sequence[str] = SERIES, clock: str = "clock", tenths: int = 8
) -> DataFrame:
    """Chronological split: the first eight tenths of each series train, the rest test."""
    placed = chunks.with_position(df, by, clock)
    train = F.col("position") <= F.expr(f"(series_rows * {tenths}L) div 10L")
    return placed.select(*df.columns, F.when(train, "train").otherwise("test").alias("part"))


def fold_by_time(df: DataFrame, by: Sequence[str] = ("host",), clock: str = "clock", folds: int = 3) -> DataFrame:
    """Contiguous blocks of equal length; the last takes the remainder."""
    placed = chunks.with_position(df, by, clock)
    block = F.expr(f"least((position - 1) div greatest(series_rows div {folds}L, 1L), {folds - 1}L)")
    return placed.select(*df.columns, block.cast("int").alias("fold"))


def trend(df: DataFrame, by: Sequence[str], value: str, clock: str, limit: float = 0.01) -> DataFrame:
    """Least-squares slope over the row index, and its direction."""
    fitted = (
        chunks.with_position(df, by, clock)
        .groupBy(*by)
        .agg(F.regr_slope(F.col(value), F.col("position").cast("double")).alias("slope"), F.count("*").alias("points"))
    )
    direction = F.when(F.col("slope") > limit, "increasing").when(F.col("slope") < -limit, "decreasing")
    return fitted.withColumn("trend_direction", direction.otherwise("stable"))


def paired_by_position(
    actual: DataFrame, forecast: DataFrame, by: Sequence[str], clock: str, forecast_clock: str
) -> DataFrame:
    """Pair the n-th actual with the n-th forecast of each series, for series of equal length only."""
    keys = [*by, "position", "series_rows"]
    left = chunks.with_position(actual, by, clock)
    right = chunks.with_position(forecast, by, forecast_clock)
    return left.join(right, keys).withColumnRenamed("position", "step").drop("series_rows")
