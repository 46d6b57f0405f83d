"""Time chunks: ordered work on series of any length without one task per series.

A window partitioned by host alone puts a whole host into one task. Here every series
is cut into chunks of fixed length in time, windows run per (series, chunk), and what a
chunk needs from its neighbours reaches it explicitly: copied rows (a halo), a running
row count, or the last and next known value. A series holds one sample per second, so a
chunk never exceeds ``seconds`` rows however large the series or skewed the host is.
Only per-chunk summaries (one row per series and chunk) are ordered per whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_SECONDS = 7 * 24 * 3600
CHUNK = "_chunk"
_OWN = "_own"


def chunk_of(clock: str, seconds: int = CHUNK_SECONDS) -> Column:
    return F.expr(f"`{clock}` div {int(seconds)}L")


def chunk_window(by: Sequence[str], clock: str, *, descending: bool = False) -> WindowSpec:
    order = F.col(clock).desc() if descending else F.col(clock)
    return Window.partitionBy(*by, CHUNK).orderBy(order)


def without_halo(df: DataFrame) -> DataFrame:
    """Keep the rows a chunk owns, after the windows that needed the copies."""
    return df.where(F.col(CHUNK) == F.col(_OWN)).drop(CHUNK, _OWN)


def _neighbour_rows(
    owned: DataFrame, by: Sequence[str], clock: str, rows: int, descending: bool
) -> DataFrame:
    """The ``rows`` rows nearest to each chunk on one side, copied into that chunk.

    Every present chunk has at least one row, so ``rows`` chunks always hold enough.
    """
    nearest_first = Window.partitionBy(*by, _OWN).orderBy(F.col(clock).asc() if descending else F.col(clock).desc())
    ordered = Window.partitionBy(*by).orderBy(F.col(_OWN).desc() if descending else F.col(_OWN))
    sizes = owned.groupBy(*by, _OWN).agg(F.count("*").alias("_size"))
    reached = sizes.select(
        *by, _OWN, F.collect_list(F.struct(_OWN, "_size")).over(ordered.rowsBetween(1, rows)).alias("_next")
    )
    targets = (
        reached.select(*by, _OWN, "_next", F.posexplode("_next").alias("_i", "_to"))
        .select(
            *by,
            _OWN,
            F.col(f"_to.{_OWN}").alias(CHUNK),
            F.aggregate(
                F.slice("_next", F.lit(1), F.col("_i")), F.lit(0).cast("bigint"), lambda acc, s: acc + s["_size"]
            ).alias("_between"),
        )
        .where(F.col("_between") < rows)
    )
    edge = owned.withColumn("_away", F.row_number().over(nearest_first)).where(F.col("_away") <= rows)
    return (
        edge.join(targets, [*by, _OWN])
        .where(F.col("_away") + F.col("_between") <= rows)
        .drop("_away", "_between")
    )


def halo(
    df: DataFrame,
    by: Sequence[str],
    clock: str,
    before: int = 0,
    after: int = 0,
    look_back: int = 0,
    seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Give each chunk the rows its windows reach: ``before`` and ``after`` rows, ``look_back`` seconds.

    A row needed in time goes to the later chunks directly; rows needed by count come from
    the nearest chunks that have any, less those already there.
    """
    owned = df.withColumn(_OWN, chunk_of(clock, seconds))
    reached = F.expr(f"(`{clock}` + {int(look_back)}L) div {int(seconds)}L")
    if look_back:
        out = owned.withColumn(CHUNK, F.explode(F.sequence(F.col(_OWN), reached)))
    else:
        out = owned.withColumn(CHUNK, F.col(_OWN))
    if before:
        earlier = _neighbour_rows(owned, by, clock, before, descending=False)
        out = out.unionByName(earlier.where(reached < F.col(CHUNK)))
    if after:
        out = out.unionByName(_neighbour_rows(owned, by, clock, after, descending=True))
    return out


def with_position(
    df: DataFrame,
    by: Sequence[str],
    clock: str,
    position: str = "position",
    size: str = "series_rows",
    seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Add each row's 1-based place in its series, and the series length."""
    owned = df.withColumn(CHUNK, chunk_of(clock, seconds))
    ordered = Window.partitionBy(*by).orderBy(CHUNK)
    sizes = owned.groupBy(*by, CHUNK).agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        *by,
        CHUNK,
        F.coalesce(F.sum("_size").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(*by)).alias(size),
    )
    return (
        owned.join(offsets, [*by, CHUNK])
        .withColumn(position, F.col("_offset") + F.row_number().over(chunk_window(by, clock)))
        .drop(CHUNK, "_offset")
    )


def with_neighbours(
    df: DataFrame, by: Sequence[str], clock: str, columns: Sequence[str], seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """For each column add structs ``_prev_c`` and ``_next_c`` (clock, value): the nearest
    known sample at or before, and at or after, the row, across the whole series."""
    owned = df.withColumn(CHUNK, chunk_of(clock, seconds))

    def known(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.struct(F.col(clock).alias("clock"), F.col(c).alias("value")))

    def known_clock(c: str) -> Column:
        return F.when(F.col(c).isNotNull(), F.col(clock))

    edges = owned.groupBy(*by, CHUNK).agg(
        *[F.max_by(known(c), known_clock(c)).alias(f"_last_{c}") for c in columns],
        *[F.min_by(known(c), known_clock(c)).alias(f"_first_{c}") for c in columns],
    )
    ordered = Window.partitionBy(*by).orderBy(CHUNK)
    earlier, later = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    carried = edges.select(
        *by,
        CHUNK,
        *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns],
        *[F.first(f"_first_{c}", ignorenulls=True).over(later).alias(f"_ahead_{c}") for c in columns],
    )
    inside = chunk_window(by, clock)
    back = inside.rowsBetween(Window.unboundedPreceding, 0)
    forth = inside.rowsBetween(0, Window.unboundedFollowing)
    joined = owned.join(carried, [*by, CHUNK])
    return joined.select(
        *df.columns,
        *[
            F.coalesce(F.last(known(c), ignorenulls=True).over(back), F.col(f"_carry_{c}")).alias(f"_prev_{c}")
            for c in columns
        ],
        *[
            F.coalesce(F.first(known(c), ignorenulls=True).over(forth), F.col(f"_ahead_{c}")).alias(f"_next_{c}")
            for c in columns
        ],
    )
