"""Exact nearest-neighbour search by trees of median cuts.

Points of a group are cut where their widest column has its median, again and again, until a leaf fits one task. A round takes
a bounded sample of every node that is still too large and makes up to eight cuts below each other from it, so a billion points need three
rounds. Searching goes from blocks of near queries down the reference tree: first each block meets the leaf that is nearest
to it, which bounds how far its neighbours can be, then all leaves whose boxes are within that bound, nearest first. The leaves
stream past the block's queries, which keep their best ``k``; nothing else leaves a task, so neither leaves nor
candidates are ever gathered.

Unknown values are null in ``point``. Points with different known columns are in groups of their own (``_known``), and distances and
boxes use the columns that both sides know.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.session import materialised

#: Points that the cuts of a node are taken from, cuts below each other in a round, and codes of a node's descendants.
SAMPLE, DEPTH, FAN = 4096, 8, 512
#: Tasks that blocks are dealt to at most, queries and references that meet in one array.
MOST_TASKS, QUERY_ROWS, REFERENCE_ROWS = 10_000, 512, 1024


def _cuts(x: np.ndarray, depth: int) -> tuple[list, list]:
    """Column and value of each cut by its place in a heap that begins at 1. Smaller values go left."""
    columns: list = [None] * (1 << depth)
    values: list = [None] * (1 << depth)
    todo = [(1, x)]
    while todo:
        place, own = todo.pop()
        if place >= 1 << depth or len(own) < 2:
            continue
        width = np.where(np.isnan(own[0]), -1.0, own.max(axis=0) - own.min(axis=0))
        c = int(width.argmax())
        if not width[c] > 0:
            continue
        order = np.sort(own[:, c])
        v = order[len(order) // 2]
        if v == order[0]:
            v = order[order > v][0]
        columns[place], values[place] = c, float(v)
        left = own[:, c] < v
        todo += [(2 * place, own[left]), (2 * place + 1, own[~left])]
    return columns, values


def _child() -> Column:
    """Where the cuts of a node lead ``point``."""
    def step(place: Column, _: Column) -> Column:
        right = F.get("point", F.get("_columns", place)) >= F.get("_values", place)
        return F.when(F.get("_columns", place).isNull(), place).otherwise(place * 2 + right.cast("int"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(1), step)


def grown(points: DataFrame, by: Sequence[str], leaf_rows: int) -> tuple[DataFrame, int, bool]:
    """``points`` (keys, point, order, ...) with ``_leaf``, the number of levels of that code in base ``FAN``, and whether a leaf may hold
    more than ``leaf_rows`` rows: it does only where its points are all equal.
    """
    keys = [*by, "_leaf"]
    types = dict(points.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in by)
    placed, levels, crowded = points.withColumn("_leaf", F.lit(0).cast("bigint")), 0, False

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows["point"].tolist(), dtype=float)
        wanted = rows["_n"].iloc[0] / (0.7 * leaf_rows)
        columns, values = _cuts(x, int(np.clip(np.ceil(np.log2(wanted)), 1, DEPTH)))
        out = rows[keys].head(1).copy()
        out["_columns"], out["_values"] = [columns], [values]
        return out if any(c is not None for c in columns) else out.head(0)

    while True:
        large = placed.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > leaf_rows)
        if large.isEmpty():
            break
        if not levels:
            placed = materialised(placed, "tree-points")
        large = materialised(large, "tree-large")
        drawn = F.pmod(F.xxhash64("order", F.lit(levels)), F.lit(1 << 30)) * F.col("_n") < F.lit(SAMPLE << 30)
        sample = placed.join(large, keys).where(drawn).select(*keys, "point", "_n")
        cuts = materialised(
            sample.groupBy(*keys).applyInPandas(cut, f"{head}, _leaf bigint, _columns array<int>, _values array<double>"), "tree-cuts"
        )
        if crowded := cuts.isEmpty():
            break
        child = F.when(F.col("_columns").isNull(), 0).otherwise(_child())
        code = (F.col("_leaf") * FAN + child).alias("_leaf")
        placed = materialised(placed.join(cuts, keys, "left").select(*points.columns, code), "tree-points")
        levels += 1
    return placed, levels, crowded


def _bounds(dims: int, low: str, high: str) -> list[Column]:
    return [
        F.array(*[F.min(F.get(low, F.lit(d))) for d in range(dims)]).alias("_low"),
        F.array(*[F.max(F.get(high, F.lit(d))) for d in range(dims)]).alias("_high"),
    ]


def _gap(dims: int, root: bool) -> Column:
    """Least distance between the boxes (_low, _high) and (_r_low, _r_high)."""
    def part(d: Column) -> Column:
        return F.greatest(F.get("_low", d) - F.get("_r_high", d), F.get("_r_low", d) - F.get("_high", d), F.lit(0.0))

    each = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), part)
    known = F.filter(each, lambda g: g.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, g: acc + g * g)
    return F.sqrt(total) if root else F.try_divide(total, F.size(known))


def _apart(dims: int) -> Column:
    """Sum of the distances of the boxes' middles, to choose between boxes that touch."""
    def part(d: Column) -> Column:
        return F.abs(F.get("_low", d) + F.get("_high", d) - F.get("_r_low", d) - F.get("_r_high", d))

    each = F.filter(F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), part), lambda g: g.isNotNull())
    return F.aggregate(each, F.lit(0.0), lambda acc, g: acc + g)


BLOCK = ["_q_known", "_q_leaf", "_q_part", "_q_scale"]


def _nodes(leaves: DataFrame, by: Sequence[str], dims: int, up: int) -> DataFrame:
    """The nodes ``up`` levels above the leaves, with their boxes and their parents' code."""
    code = F.floor(F.col("_leaf") / F.lit(FAN**up)).cast("bigint") if up else F.col("_leaf")
    rows = leaves.withColumn("_code", code).groupBy(*by, "_known", "_code").agg(*_bounds(dims, "_low", "_high"))
    return rows.select(
        *by, F.col("_known").alias("_r_known"), F.col("_code").alias("_r_code"), F.floor(F.col("_code") / FAN).cast("bigint").alias("_up"),
        F.col("_low").alias("_r_low"), F.col("_high").alias("_r_high"),
    )


def _down(
    blocks: DataFrame, leaves: DataFrame, levels: int, by: Sequence[str], dims: int, root: bool, imputing: bool, nearest: bool
) -> DataFrame:
    """Pairs of blocks and leaves: with ``nearest`` the leaf of each group of references that is found by going to the nearest child
    each time, else all leaves within the block's ``_reach``."""
    keys = list(by)
    pairs = blocks
    for level in range(levels + 1):
        nodes = _nodes(leaves, keys, dims, levels - level)
        if level == 0:
            met = pairs.join(nodes.drop("_up"), keys)
        else:
            met = pairs.withColumnRenamed("_r_code", "_up").drop("_r_low", "_r_high", "_gap").join(nodes, [*keys, "_r_known", "_up"]).drop("_up")
        met = met.withColumn("_gap", _gap(dims, root))
        if nearest:
            order = Window.partitionBy(*keys, *BLOCK, "_r_known").orderBy("_gap", _apart(dims), "_r_code")
            met = met.where("_gap IS NOT NULL").withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
        elif imputing:
            met = met.where(F.exists(
                F.sequence(F.lit(0), F.lit(dims - 1)),
                lambda d: F.get("_r_low", d).isNotNull() & (F.get("_reach", d) >= F.col("_gap")),
            ))
        else:
            met = met.where(F.get("_reach", F.lit(0)) >= F.col("_gap"))
        pairs = met
    return pairs.select(*keys, *BLOCK, "_r_known", F.col("_r_code").alias("_r_leaf"), "_gap")


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays, null as nan."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1)


class _Block:
    """The queries of a block and the best that they have met."""

    def __init__(self, k: int, root: bool, imputing: bool):
        self.k, self.root, self.imputing = k, root, imputing
        self.batches: list[pa.RecordBatch] = []
        self.ready = False

    def begin(self) -> None:
        self.q = np.concatenate([_matrix(b.column("point")) for b in self.batches])
        self.known = ~np.isnan(self.q[0])
        self.targets = np.flatnonzero(~self.known) if self.imputing else np.zeros(1, np.int64)
        width = len(self.batches[0].column("order")[0])
        shape = (len(self.q), len(self.targets), self.k)
        self.distance = np.full(shape, np.inf)
        self.order = np.full((*shape, width), np.inf)
        self.point = np.full((*shape, self.q.shape[1]), np.nan)
        self.weight = np.zeros(shape, np.int64)
        self.ready = True

    def _measured(self, parts: Iterator[np.ndarray], n: int) -> np.ndarray:
        total = 0.0
        for p in parts:
            total = total + p * p
        return np.sqrt(total) if self.root else total / n

    def meet(self, x: np.ndarray, order: np.ndarray, weight: np.ndarray) -> None:
        known = ~np.isnan(x[0])
        shared = np.flatnonzero(self.known & known)
        if not len(shared):
            return
        by_order = np.lexsort(order.T[::-1])
        x, order, weight = x[by_order], order[by_order], weight[by_order]
        low, high = x.min(axis=0), x.max(axis=0)
        for t, target in enumerate(self.targets):
            if self.imputing and not known[target]:
                continue
            gap = self._measured((np.maximum(np.maximum(low[d] - self.q[:, d], self.q[:, d] - high[d]), 0) for d in shared), len(shared))
            active = np.flatnonzero(gap <= self.distance[:, t, -1])
            for a in range(0, len(active), QUERY_ROWS):
                self._merge(active[a : a + QUERY_ROWS], t, shared, x, order, weight)

    def _merge(self, rows: np.ndarray, t: int, shared: np.ndarray, x: np.ndarray, order: np.ndarray, weight: np.ndarray) -> None:
        k, q = self.k, self.q[rows]
        far = self._measured((q[:, d, None] - x[None, :, d] for d in shared), len(shared))
        most = self.distance[rows, t, -1]
        if len(x) > k:
            most = np.minimum(most, np.partition(far, k - 1, axis=1)[:, k - 1])
        at, to = np.nonzero(far <= most[:, None])
        own = far[at, to]
        best = np.lexsort((to, own, at))
        at, to, own = at[best], to[best], own[best]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        at, to, own, rank = at[rank < k], to[rank < k], own[rank < k], rank[rank < k]
        if not len(at):
            return
        hit, place = np.unique(at, return_inverse=True)
        rows = rows[hit]

        def both(old: np.ndarray, new: np.ndarray, empty: float) -> np.ndarray:
            more = np.full_like(old, empty)
            more[place, rank] = new
            return np.concatenate([old, more], axis=1)

        distance = both(self.distance[rows, t], own, np.inf)
        orders = both(self.order[rows, t], order[to], np.inf)
        first = np.lexsort((*(orders[..., j] for j in reversed(range(orders.shape[-1]))), distance), axis=-1)[:, :k]
        self.distance[rows, t] = np.take_along_axis(distance, first, 1)
        self.order[rows, t] = np.take_along_axis(orders, first[..., None], 1)
        self.point[rows, t] = np.take_along_axis(both(self.point[rows, t], x[to], np.nan), first[..., None], 1)
        self.weight[rows, t] = np.take_along_axis(both(self.weight[rows, t], weight[to], 0), first, 1)

    def found(self, keys: list[str]) -> Iterator[pa.RecordBatch]:
        """The queries with their neighbours, or with the mean of these for each unknown column."""
        done, m, dims = 0, *self.q.shape
        for b in self.batches:
            own = slice(done, done + len(b))
            done += len(b)
            columns = {c: b.column(c) for c in [*keys, "point", "order"]}
            distance = self.distance[own]
            many = np.isfinite(distance)
            if self.imputing:
                fills, reach = np.full((len(b), dims), np.nan), np.full((len(b), dims), np.nan)
                for t, target in enumerate(self.targets):
                    # Summed with spare digits, so that the order of the neighbours does not show.
                    total = np.where(many[:, t], self.point[own, t, :, target], 0.0).astype(np.longdouble).sum(axis=1).astype(float)
                    with np.errstate(invalid="ignore"):
                        fills[:, target] = total / many[:, t].sum(axis=1)
                    reach[:, target] = distance[:, t, -1]
                columns["reach"], columns["found"] = _lists(reach), _lists(fills)
            else:
                many = many[:, 0]
                flat = pa.StructArray.from_arrays(
                    [pa.array(distance[:, 0][many]), _lists(self.point[own, 0][many]), pa.array(self.weight[own, 0][many])],
                    names=["distance", "point", "weight"],
                )
                offsets = np.append(0, np.cumsum(many.sum(axis=1))).astype(np.int32)
                columns["reach"] = _lists(distance[:, 0, -1:])
                columns["found"] = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as arrays, nan as null."""
    offsets = (np.arange(len(x) + 1) * x.shape[1]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), from_pandas=True))


def _searched(
    pairs: DataFrame, queries: DataFrame, references: DataFrame, by: Sequence[str], k: int, root: bool, imputing: bool
) -> DataFrame:
    """The queries with the best ``k`` of the leaves that their block is paired with: keys, point, order, reach, found."""
    keys = list(by)
    block = [*keys, *BLOCK]
    blocks = pairs.select(*block).distinct()
    tasks = max(1, min(MOST_TASKS, blocks.count()))
    none = F.lit(None)
    left = queries.join(blocks, block, "left_semi").select(
        *block, F.lit(0).alias("_kind"), F.lit(-1.0).alias("_gap"), none.cast("string").alias("_r_known"), none.cast("bigint").alias("_r_leaf"),
        "point", "order", F.lit(0).cast("bigint").alias("weight"),
    )
    leaf = references.select(*keys, F.col("_known").alias("_r_known"), F.col("_leaf").alias("_r_leaf"), "point", "order", "weight")
    right = pairs.join(leaf, [*keys, "_r_known", "_r_leaf"]).select(
        *block, F.lit(1).alias("_kind"), "_gap", "_r_known", "_r_leaf", "point", "order", "weight"
    )
    rows = left.unionByName(right).repartition(tasks, *block).sortWithinPartitions(*block, "_kind", "_gap", "_r_known", "_r_leaf")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(k, root, imputing)
        for batch in batches:
            kind = batch.column("_kind").to_numpy()
            leaf = batch.column("_r_leaf").to_numpy(zero_copy_only=False)
            code = batch.column("_r_known").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            turn = (np.diff(kind) != 0) | ((kind[1:] == 1) & ((leaf[1:] != leaf[:-1]) | (code[1:] != code[:-1])))
            cuts = [0, *(np.flatnonzero(turn) + 1).tolist(), len(kind)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if block.ready:  # its references are through: the next block begins
                        yield from block.found(keys)
                        block = _Block(k, root, imputing)
                    block.batches.append(part)
                    continue
                if not block.ready:
                    block.begin()
                for at in range(0, b - a, REFERENCE_ROWS):
                    few = part.slice(at, REFERENCE_ROWS)
                    block.meet(_matrix(few.column("point")), _matrix(few.column("order")), few.column("weight").to_numpy())
        if block.ready:
            yield from block.found(keys)

    types = dict(queries.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in keys)
    found = "array<double>" if imputing else "array<struct<distance:double,point:array<double>,weight:bigint>>"
    return rows.mapInArrow(search, f"{head}, point array<double>, order array<double>, reach array<double>, found {found}")


def nearest(
    queries: DataFrame, references: DataFrame | None, by: Sequence[str], dims: int, k: int, leaf_rows: int, imputing: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(results, pairs). Results have the keys, point and order of each query and ``found``; pairs are the blocks and leaves that met.

    Both inputs have keys, ``_known``, ``point`` and ``order`` (array<double>, decides between equal distances), references a ``weight``
    too; without references the queries, which then have a weight, are searched for themselves. ``found`` holds the ``k``
    nearest by Euclid's distance as (distance, point, weight). With ``imputing`` it holds, for each column that the query lacks,
    the mean over the ``k`` nearest references that know it, by mean square over the columns that both know; null where there are none.
    Queries without any reference have no result.
    """
    keys, root = list(by), not imputing
    group = [*keys, "_known"]
    tree = grown(queries, group, leaf_rows)
    placed, _, crowded = tree
    stored, depth, _ = tree if references is None else grown(references, group, leaf_rows)
    # Equal points cannot be cut; past a leaf's rows their queries are dealt out by their order.
    part = F.lit(0)
    if crowded:
        full = placed.groupBy(*group, "_leaf").agg(F.count("*").alias("_n")).where(F.col("_n") > leaf_rows)
        placed = placed.join(full, [*group, "_leaf"], "left")
        part = F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("order"), F.ceil(F.col("_n") / leaf_rows)))
    asked = placed.select(
        *keys, F.col("_known").alias("_q_known"), F.col("_leaf").alias("_q_leaf"), part.cast("bigint").alias("_q_part"), "point", "order"
    )
    first = asked.withColumn("_q_scale", F.lit(0).cast("bigint"))
    if depth == 0:  # every group of references is one leaf, and all that a block can need meet it
        each = stored.select(*keys, F.col("_known").alias("_r_known"), F.col("_leaf").alias("_r_leaf"), F.lit(0.0).alias("_gap")).distinct()
        pairs = first.select(*keys, *BLOCK).distinct().join(each, keys)
        return _searched(pairs, first, stored, keys, k, root, imputing).select(*keys, "point", "order", "found"), pairs
    leaves = materialised(stored.groupBy(*group, "_leaf").agg(*_bounds(dims, "point", "point"), F.count("*").alias("_n")), "tree-leaves")
    blocks = first.groupBy(*keys, *BLOCK).agg(*_bounds(dims, "point", "point"))
    start = materialised(_down(blocks, leaves, depth, keys, dims, root, imputing, nearest=True), "tree-start")
    met = _searched(start, first, stored, keys, k, root, imputing)
    bounds = materialised(met.select(*keys, "order", "reach"), "tree-bounds")
    # Queries of a leaf that reach much further than others are blocks of their own.
    widest = F.coalesce(F.array_max("reach"), F.lit(0.0))
    scale = F.when(widest == float("inf"), 5000).when(widest > 0, F.floor(F.log2(widest))).otherwise(-5000).cast("bigint")
    reaching = materialised(asked.join(bounds.withColumn("_q_scale", scale), [*keys, "order"]), "tree-queries")
    width = dims if imputing else 1
    blocks = reaching.groupBy(*keys, *BLOCK).agg(
        *_bounds(dims, "point", "point"), F.array(*[F.max(F.get("reach", F.lit(i))) for i in range(width)]).alias("_reach")
    )
    pairs = materialised(_down(blocks, leaves, depth, keys, dims, root, imputing, nearest=False), "tree-pairs")
    return _searched(pairs, reaching, stored, keys, k, root, imputing).select(*keys, "point", "order", "found"), pairs
