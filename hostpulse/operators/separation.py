"""How far two groups of rows lie apart, by true distances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.operators.neighbours import HOST, as_points
from hostpulse.operators.trees import MOST_TASKS
from hostpulse.session import materialised

#: Distinct points that a task holds, and references that it takes at a time.
BLOCK_ROWS, AT_ONCE = 4096, 1024


def silhouette(
    df: DataFrame, features: Sequence[str], label: str = "is_anomaly", by: Sequence[str] = HOST, minimum: int = 10, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Keys, rows and silhouette_score: the mean over the rows of a key of (b - a) / max(a, b), where a is a row's mean Euclidean
    distance to the other rows of its label and b that to the rows of the other label.

    ``label`` is 0 or 1 (true or false); rows without one are left out, and unknown features count as 0. A row that is alone in its
    label scores 0, and so does one with a = b = 0. There is no score for ``minimum`` rows or fewer, or with a single label. Equal rows are
    one point with a weight. Points are cut into blocks by hash; all points of the key stream past each block, which keeps a sum
    per point and label. The work grows with the square of a key's distinct points, as the score does; ``ensemble.silhouette``, by
    squared distances, does with sums alone.
    """
    keys = list(by)
    rows = as_points(df.where(F.col(label).isNotNull()), features).withColumn("_label", F.col(label).cast("int"))
    points = materialised(rows.groupBy(*keys, "_label", "point").agg(F.count("*").alias("weight")), "separation-points")
    sizes = points.groupBy(*keys).agg(
        F.ceil(F.count("*") / block_rows).alias("_blocks"), F.sum("weight").alias("rows"),
        *[F.coalesce(F.sum(F.when(F.col("_label") == i, F.col("weight"))), F.lit(0)).alias(f"_n{i}") for i in (0, 1)],
    )
    sizes = materialised(sizes, "separation-sizes")
    wanted = sizes.where((F.col("rows") > minimum) & (F.col("_n0") > 0) & (F.col("_n1") > 0))
    blocks = wanted.agg(F.coalesce(F.sum("_blocks"), F.lit(0))).first()[0]
    placed = points.join(wanted.select(*keys, "_blocks"), keys)
    own = placed.withColumn("_block", F.pmod(F.xxhash64("_label", "point"), F.col("_blocks"))).withColumn("_kind", F.lit(0))
    every = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1))).withColumn("_kind", F.lit(1))
    group = [*keys, "_block"]
    together = own.unionByName(every).drop("_blocks").repartition(max(1, min(MOST_TASKS, int(blocks))), *group).sortWithinPartitions(
        *group, "_kind", "_label", "point"
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.RecordBatch] = []
        x = sums = None

        def done() -> Iterator[pa.RecordBatch]:
            at = 0
            for b in asked:
                part = sums[at : at + len(b)]
                at += len(b)
                columns = {c: b.column(c) for c in [*keys, "_label", "weight"]} | {f"_to{i}": pa.array(part[:, i]) for i in (0, 1)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            kind = batch.column("_kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if x is not None:  # all points have passed: the next block begins
                        yield from done()
                        asked, x = [], None
                    asked.append(part)
                    continue
                if x is None:
                    x = np.concatenate([p.column("point").flatten().to_numpy().reshape(len(p), -1) for p in asked])
                    sums = np.zeros((len(x), 2))
                for c in range(0, len(part), AT_ONCE):
                    few = part.slice(c, AT_ONCE)
                    y = few.column("point").flatten().to_numpy().reshape(len(few), -1)
                    square = np.zeros((len(x), len(y)))
                    for d in range(x.shape[1]):
                        square += (x[:, d, None] - y[None, :, d]) ** 2
                    distance = np.sqrt(square)
                    weight, group_of = few.column("weight").to_numpy(), few.column("_label").to_numpy()
                    for i in (0, 1):
                        sums[:, i] += distance @ np.where(group_of == i, weight, 0).astype(float)
        if x is not None:
            yield from done()

    types = dict(df.dtypes)
    head = ", ".join(f"{c} {types[c]}" for c in keys)
    sums = together.mapInArrow(add, f"{head}, _label int, weight bigint, _to0 double, _to1 double").join(wanted, keys)
    first = F.col("_label") == 0
    n, m = F.when(first, F.col("_n0")).otherwise(F.col("_n1")), F.when(first, F.col("_n1")).otherwise(F.col("_n0"))
    inner = F.try_divide(F.when(first, F.col("_to0")).otherwise(F.col("_to1")), n - 1)
    outer = F.when(first, F.col("_to1")).otherwise(F.col("_to0")) / m
    score = F.when(n == 1, 0.0).otherwise(F.coalesce(F.try_divide(outer - inner, F.greatest(inner, outer)), F.lit(0.0)))
    scores = sums.groupBy(*keys).agg((F.sum(score * F.col("weight")) / F.sum("weight")).alias("silhouette_score"))
    return sizes.select(*keys, "rows").join(scores, keys, "left")
