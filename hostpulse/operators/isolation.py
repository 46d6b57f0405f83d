"""Isolation forest per key: trees grown in parallel from small samples, rows scored in chunks.

A tree needs at most 256 rows, so growing never depends on the data's size. A row is
scored against its key's forest in blocks of bounded size; the forest goes to each block,
never to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.operators.quantiles import exact_quantiles
from hostpulse.session import spread

TREES, SAMPLE = 100, 256
SCORE_ROWS = 200_000  # rows of a key scored together
BATCH = 10  # trees grown per task input
HOST = ("host",)
TREE_COLUMNS = (
    "tree int, sample bigint, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
    "length array<double>"
)
_UNIT = 1 << 40


def expected_length(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    long = 2.0 * (np.log(np.maximum(n - 1, 1.0)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1.0)
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator) -> dict[str, list]:
    """One tree: random feature, random cut between its extremes, down to log2 of the sample."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    tree: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "length": []}
    todo = [(np.arange(len(x)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(tree["feature"])
        if parent is not None:
            tree[side][parent] = node
        part = x[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) > 1 else (np.zeros(1), np.zeros(1))
        varied = np.flatnonzero(high > low)
        leaf = depth >= limit or not len(varied)
        feature = -1 if leaf else int(varied[rng.integers(len(varied))])
        cut = 0.0 if leaf else float(low[feature] + (high[feature] - low[feature]) * rng.random())
        for name, value in (("feature", feature), ("threshold", cut), ("left", -1), ("right", -1)):
            tree[name].append(value)
        tree["length"].append(float(depth + expected_length(len(rows))) if leaf else 0.0)
        if not leaf:
            below = part[:, feature] < cut
            todo.append((rows[below], depth + 1, node, "left"))
            todo.append((rows[~below], depth + 1, node, "right"))
    return tree


def forest_lengths(x: np.ndarray, model: pd.DataFrame, rows: int = 4_096) -> np.ndarray:
    """Sum of the path lengths over all trees, every tree one step down at a time."""
    width = max(len(f) for f in model["feature"])

    def table(name: str, fill: float) -> np.ndarray:
        out = np.full((len(model), width), fill)
        for i, v in enumerate(model[name]):
            out[i, : len(v)] = v
        return out.ravel()

    feature, cut, length = table("feature", -1).astype(int), table("threshold", 0.0), table("length", 0.0)
    left, right = table("left", -1).astype(int), table("right", -1).astype(int)
    root = np.arange(len(model)) * width
    total = np.empty(len(x))
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        node = np.tile(root, (len(part), 1))
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            value = np.take_along_axis(part, np.maximum(f, 0), axis=1)
            node = np.where(inner, np.where(value < cut[node], left[node], right[node]) + root, node)
        total[a : a + rows] = length[node].sum(axis=1)
    return total


def _features(columns: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def tree_samples(
    df: DataFrame, columns: Sequence[str], by: Sequence[str], clock: str, trees: int, sample: int, seed: int
) -> DataFrame:
    """Rows per tree, chosen by hash: a pool per key first, then each tree's rows out of the pool."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("_n"))
    rows = df.select(*by, clock, _features(columns).alias("_x")).join(sizes, list(by))

    def draw(*extra: Column) -> Column:
        return F.pmod(F.xxhash64(*by, clock, F.lit(seed), *extra), F.lit(_UNIT)).cast("double") / _UNIT

    pool_rows = 4.0 * trees * sample
    drawn = rows.where(draw(F.lit(-1)) < F.lit(pool_rows) / F.col("_n"))
    pool = spread(drawn, *by, clock).withColumn("_pool", F.least(F.lit(pool_rows), F.col("_n").cast("double")))
    enough = F.lit(2.0 * sample) / F.col("_pool")
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < enough)
    taken = pool.withColumn("tree", F.explode(chosen)).withColumn("_u", draw(F.col("tree")))
    first = Window.partitionBy(*by, "tree").orderBy("_u", clock)
    return taken.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= sample).drop("_rank", "_u", "_pool")


def fit_forest(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = HOST,
    clock: str = "clock",
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """One row per key and tree. The sample is all rows of keys that have fewer."""
    keys, types = list(by), dict(df.dtypes)
    key_types = ", ".join(f"{c} {types[c]}" for c in keys)

    def grow_batch(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, rows in pdf.groupby("tree"):
            rows = rows.sort_values(clock)
            rng = np.random.default_rng([seed, int(tree)])
            out.append(
                {**{c: rows[c].iloc[0] for c in keys}, "tree": int(tree), "sample": len(rows),
                 **grow(np.array(rows["_x"].tolist()), rng)}
            )
        return pd.DataFrame(out)

    samples = tree_samples(df, columns, keys, clock, trees, sample, seed)
    batched = spread(samples.withColumn("_batch", F.expr(f"tree div {BATCH}")), *keys, "_batch")
    return batched.groupBy(*keys, "_batch").applyInPandas(grow_batch, f"{key_types}, {TREE_COLUMNS}")


def forest_scores(
    df: DataFrame, forest: DataFrame, columns: Sequence[str], by: Sequence[str] = HOST, clock: str = "clock"
) -> DataFrame:
    """Add ``if_score``, the negated anomaly score: from -1 (isolated at once) to 0; low is anomalous."""
    keys, types = list(by), dict(df.dtypes)
    key_types = ", ".join(f"{c} {types[c]}" for c in keys)
    # Rows need no order here: a key is cut into as few blocks as memory allows, and the forest goes to each once.
    blocks = df.groupBy(*keys).agg(F.ceil(F.count("*") / SCORE_ROWS).cast("int").alias("_blocks"))
    rows = df.select(*keys, clock, _features(columns).alias("_x")).join(blocks, keys)
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(clock), F.col("_blocks")).cast("int")).drop("_blocks")
    places = blocks.select(*keys, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    group = [*keys, "_block"]

    def score(data: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = data[[*keys, clock]].copy()
        if data.empty or model.empty:
            return out.assign(if_score=np.full(len(out), np.nan))
        x = np.array(data["_x"].tolist())
        total = forest_lengths(x, model)
        normal = float(expected_length(model["sample"].iloc[0])) or 1.0
        return out.assign(if_score=-np.exp2(-total / len(model) / normal))

    models = forest.join(places, keys)
    # New column identities: both sides of the cogroup come from the scored rows.
    models = spread(models.toDF(*models.columns), *group)
    scored = spread(rows, *group).groupBy(*group).cogroup(models.groupBy(*group)).applyInPandas(
        score, f"{key_types}, {clock} bigint, if_score double"
    )
    return df.join(scored, [*keys, clock])


def score_offsets(
    scored: DataFrame, score: str, contamination: float | Sequence[float], by: Sequence[str] = HOST
) -> DataFrame:
    """Score below which the given share of the training rows lies; an array for several shares."""
    if isinstance(contamination, float):
        return exact_quantiles(scored, by, score, [contamination]).select(
            *by, F.col("quantiles")[0].alias(f"{score}_offset")
        )
    return exact_quantiles(scored, by, score, list(contamination), output=f"{score}_offsets")


def flagged(scored: DataFrame, offsets: DataFrame, score: str, flag: str, by: Sequence[str] = HOST) -> DataFrame:
    return scored.join(offsets, list(by)).select(
        *scored.columns, (F.col(score) < F.col(f"{score}_offset")).cast("int").alias(flag)
    )
