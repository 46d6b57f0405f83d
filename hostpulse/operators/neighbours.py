"""Exact nearest neighbours, local outlier factor, neighbour imputation and oversampling.

Equal points are first merged into one with a weight, so copies cost nothing. The search itself is that of ``trees``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostpulse.operators import trees
from hostpulse.session import materialised

#: Points in a leaf of a search tree, and so queries that a task holds at a time.
BLOCK_ROWS = 4096
HOST = ("host",)


def as_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``point``: the columns as one array, unknown values 0."""
    return df.withColumn("point", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]))


def distinct_points(df: DataFrame, by: Sequence[str] = HOST) -> DataFrame:
    return df.groupBy(*by, "point").agg(F.count("*").alias("weight"))


def _searchable(points: DataFrame, by: Sequence[str]) -> DataFrame:
    return points.select(
        *by, F.lit("").alias("_known"), "point", F.col("point").alias("order"),
        *(["weight"] if "weight" in points.columns else []),
    )


def _search(queries: DataFrame, reference: DataFrame, k: int, dimensions: int, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    own = queries is reference
    return trees.nearest(
        _searchable(queries if own else queries.select(*by, "point"), by), None if own else _searchable(reference, by),
        by, dimensions, k, BLOCK_ROWS,
    )


def nearest_points(
    queries: DataFrame, reference: DataFrame, k: int, dimensions: int, by: Sequence[str] = HOST
) -> DataFrame:
    """For distinct query points, the ``k`` nearest distinct reference points of the same key.

    ``queries`` has (keys, point), ``reference`` (keys, point, weight); they may be the same frame. The result has
    ``neighbours``: array of (distance, point, weight), nearest first, of equal distances the smaller point.
    """
    found, _ = _search(queries, reference, k, dimensions, by)
    return found.select(*by, "point", F.col("found").alias("neighbours"))


def visited_pairs(df: DataFrame, columns: Sequence[str], k: int = 5, by: Sequence[str] = HOST) -> DataFrame:
    """Per key how much of its pairs of distinct points the search for each point's ``k`` neighbours looks at: the number of
    points and of leaves, and how many leaves a block of queries meets in the mean."""
    points = distinct_points(as_points(df, columns), by)
    _, pairs = _search(points, points, k + 1, len(columns), by)
    block = F.struct(*trees.BLOCK)
    met = pairs.groupBy(*by).agg(
        F.count_distinct("_r_leaf").alias("n_leaves"), (F.count("*") / F.count_distinct(block)).alias("leaves_per_block")
    )
    return points.groupBy(*by).agg(F.count("*").alias("n_points")).join(met, list(by))


def _counted(k: int, drop_self: bool) -> Column:
    """Neighbours with the share of their weight that belongs to the k nearest."""
    own = F.col("neighbours")
    if drop_self:
        own = F.filter(
            F.transform(
                own,
                lambda n: F.struct(
                    n["distance"].alias("distance"), n["point"].alias("point"),
                    (n["weight"] - (n["point"] == F.col("point")).cast("bigint")).alias("weight"),
                ),
            ),
            lambda n: n["weight"] > 0,
        )
    start = F.struct(
        F.lit(0).cast("bigint").alias("total"),
        F.filter(F.transform(own, lambda n: n), lambda n: F.lit(False)).alias("taken"),
    )

    def take(acc: Column, n: Column) -> Column:
        used = F.least(n["weight"], F.lit(k) - acc["total"])
        item = F.struct(n["distance"].alias("distance"), n["point"].alias("point"), used.alias("weight"))
        return F.struct(
            (acc["total"] + used).alias("total"),
            F.when(used > 0, F.concat(acc["taken"], F.array(item))).otherwise(acc["taken"]).alias("taken"),
        )

    return F.aggregate(own, start, take, lambda acc: acc["taken"])


def k_nearest(df: DataFrame, columns: Sequence[str], k: int = 5, by: Sequence[str] = HOST) -> DataFrame:
    """Per row the k nearest other rows of its key, as (rank, distance, point)."""
    rows = as_points(df, columns)
    points = distinct_points(rows, by)
    near = nearest_points(points, points, k + 1, len(columns), by)
    repeated = near.select(
        *by,
        "point",
        F.posexplode(
            F.flatten(F.transform(_counted(k, drop_self=True), lambda n: F.array_repeat(n, n["weight"].cast("int"))))
        ).alias("_i", "_n"),
    )
    return rows.join(repeated, [*by, "point"]).select(
        *df.columns, (F.col("_i") + 1).alias("rank"), F.col("_n.distance").alias("distance"),
        F.col("_n.point").alias("neighbour"),
    )


def _edges(near: DataFrame, k: int, drop_self: bool, by: Sequence[str]) -> DataFrame:
    return near.select(*by, "point", F.explode(_counted(k, drop_self)).alias("_n")).select(
        *by, "point", F.col("_n.distance").alias("distance"), F.col("_n.point").alias("_to"),
        F.col("_n.weight").alias("_w"),
    )


def _density(edges: DataFrame, reach: DataFrame, by: Sequence[str]) -> DataFrame:
    """Local reachability density; ``reach`` has (keys, point, k_distance)."""
    far = edges.join(reach.withColumnRenamed("point", "_to"), [*by, "_to"])
    reachable = F.greatest("k_distance", "distance") * F.col("_w")
    return far.groupBy(*by, "point").agg(
        (F.lit(1.0) / (F.sum(reachable) / F.sum("_w") + 1e-10)).alias("density")
    )


def _factor(edges: DataFrame, own: DataFrame, model: DataFrame, by: Sequence[str]) -> DataFrame:
    around = model.select(*by, F.col("point").alias("_to"), F.col("density").alias("_around"))
    mean = edges.join(around, [*by, "_to"]).groupBy(*by, "point").agg(
        (F.sum(F.col("_around") * F.col("_w")) / F.sum("_w")).alias("_mean")
    )
    return mean.join(own, [*by, "point"]).select(*by, "point", (F.col("_mean") / F.col("density")).alias("lof"))


def fit_lof(df: DataFrame, columns: Sequence[str], k: int = 20, by: Sequence[str] = HOST) -> DataFrame:
    """Model per distinct training point: weight, k-distance, density and its own outlier factor."""
    points = materialised(distinct_points(as_points(df, columns), by), "points")
    near = materialised(nearest_points(points, points, k + 1, len(columns), by), "nearest")
    edges = _edges(near, k, True, by)
    reach = edges.groupBy(*by, "point").agg(F.max("distance").alias("k_distance"))
    density = materialised(_density(edges, reach, by).join(reach, [*by, "point"]), "densities")
    factors = _factor(edges, density.select(*by, "point", "density"), density, by)
    return points.join(density, [*by, "point"]).join(factors, [*by, "point"])


def lof_scores(
    df: DataFrame, model: DataFrame, columns: Sequence[str], k: int = 20, by: Sequence[str] = HOST
) -> DataFrame:
    """Score rows against a fitted model: ``lof_score`` is the negated factor, low is anomalous."""
    rows = as_points(df, columns)
    queries = rows.select(*by, "point").distinct()
    near = materialised(
        nearest_points(queries, model.select(*by, "point", "weight"), k, len(columns), by), "query-nearest"
    )
    edges = _edges(near, k, False, by)
    own = _density(edges, model.select(*by, "point", "k_distance"), by)
    factors = _factor(edges, own, model, by)
    return rows.join(factors, [*by, "point"]).select(*df.columns, (-F.col("lof")).alias("lof_score"))


def knn_imputed(
    df: DataFrame, columns: Sequence[str], k: int = 5, by: Sequence[str] = HOST, clock: str = "clock",
    reference: DataFrame | None = None,
) -> DataFrame:
    """Fill each gap with the mean of that column over the k nearest rows that know it.

    Distance uses the columns both rows know, scaled up to all columns; equal distances
    prefer the earlier row. A gap nothing compares with takes the column's mean. Rows are
    compared with those of ``reference``, by default with each other; a key it lacks keeps its gaps.
    Reference rows are indexed by the columns that they know, each such group in a tree of its own.
    """
    keys, columns = list(by), list(columns)
    reference = df if reference is None else reference

    def placed(rows: DataFrame) -> DataFrame:
        known = F.concat(*[F.when(F.col(c).isNull(), "0").otherwise("1") for c in columns])
        return rows.select(
            *keys, known.alias("_known"), F.array(*[F.col(c).cast("double") for c in columns]).alias("point"),
            F.array(F.col(clock).cast("double")).alias("order"), F.lit(1).cast("bigint").alias("weight"),
        )

    gaps = placed(df).where(F.col("_known").contains("0") & F.col("_known").contains("1")).drop("weight")
    known = placed(reference).where(F.col("_known").contains("1"))
    found, _ = trees.nearest(gaps, known, keys, len(columns), k, BLOCK_ROWS, imputing=True)
    fills = found.select(
        *keys, F.get("order", F.lit(0)).cast(dict(df.dtypes)[clock]).alias(clock), F.col("found").alias("_fills")
    )
    means = reference.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in columns])
    joined = df.join(fills, [*keys, clock], "left").join(means, keys, "left")
    return joined.select(
        *[
            F.coalesce(F.col(c), F.get("_fills", F.lit(columns.index(c))), F.col(f"_mean_{c}")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def oversampled(
    df: DataFrame, columns: Sequence[str], label: str, k: int = 5, by: Sequence[str] = HOST, clock: str = "clock",
    seed: int = 42,
) -> DataFrame:
    """Add synthetic minority rows per key until both classes are equal.

    Each lies on the line from a minority row to one of its k nearest minority rows; row,
    neighbour and place follow from hashes, so a rerun gives the same rows. Keys with
    fewer than two minority rows stay as they are. Synthetic rows have no time.
    """
    from hostpulse.operators.chunks import with_position

    counts = df.groupBy(*by).agg(F.sum(label).alias("_ones"), F.count("*").alias("_all"))
    minority = F.when(F.col("_ones") * 2 <= F.col("_all"), 1).otherwise(0)
    small = F.least("_ones", F.col("_all") - F.col("_ones"))
    plan = counts.select(
        *by, minority.alias("_label"), small.alias("_small"), (F.col("_all") - small * 2).alias("_missing")
    ).where((F.col("_small") > 1) & (F.col("_missing") > 0))
    few = df.join(plan, list(by)).where(F.col(label) == F.col("_label"))
    near = k_nearest(few.select(*by, clock, *columns), columns, k, by).groupBy(*by, clock).agg(
        F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("_near")
    )
    placed = with_position(few, by, clock, "_place", "_size").join(near, [*by, clock])
    copies = F.expr("_missing div _small") + (F.col("_place") <= F.col("_missing") % F.col("_small")).cast("bigint")
    each = placed.withColumn("_copies", copies).where("_copies > 0").withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies")))
    )
    draw = F.xxhash64(*by, clock, "_copy", F.lit(seed))
    pick = F.get("_near", F.pmod(draw, F.size("_near")).cast("int"))["neighbour"]
    share = F.pmod(F.xxhash64(*by, clock, "_copy", F.lit(seed + 1)), F.lit(1 << 20)).cast("double") / (1 << 20)
    drawn = each.select(*by, F.col("_label").alias(label), *columns, pick.alias("_to"), share.alias("_share"))
    synthetic = drawn.select(
        *by,
        F.lit(None).cast("bigint").alias(clock),
        F.col(label).cast(dict(df.dtypes)[label]).alias(label),
        *[(F.col(c) + (F.get("_to", F.lit(i)) - F.col(c)) * F.col("_share")).alias(c) for i, c in enumerate(columns)],
    )
    return df.select(*by, clock, label, *columns).unionByName(synthetic)
