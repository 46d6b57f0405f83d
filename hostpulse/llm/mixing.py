"""Mixing sources to target weights by hierarchical budgets.

A token budget goes down a tree of domains, languages and sources by weight. A node that has less than its share keeps
what it has, and its shortage goes to its siblings first; only what all siblings together cannot take goes to the siblings of
the parent. A leaf's budget is filled from seeded epochs: each epoch has the leaf's documents in an order of its own, and
the beginning of the epochs, by tokens, is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.llm.common import WORD, fresh_name

#: Ranges the seeded order is cut into, so that no task sorts a whole leaf.
RANGES = 1_024
#: Leaves the driver may hold; they are kinds of sources, not documents.
MAX_LEAVES = 200_000


def word_tokens(column: str = "text") -> Column:
    """Words of a text, null as none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def water_fill(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Shares by weight that exceed no room; what one cannot take goes to the others by weight."""
    out, open_ = [0.0] * len(room), [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] <= left * weights[i] / total]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = room[i]
        left -= sum(room[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def budgets(
    supply: dict[tuple, int], weight: Callable[[tuple], float], total: float, epochs: int,
) -> dict[tuple, float]:
    """Tokens for each leaf. ``supply``: tokens once through, by path; ``weight`` of a node by its path (siblings relative)."""
    room: dict[tuple, float] = {}
    for path, n in supply.items():
        for depth in range(len(path) + 1):
            room[path[:depth]] = room.get(path[:depth], 0) + n * epochs
    children: dict[tuple, list[tuple]] = {}
    for node in sorted(room, key=lambda p: (len(p), tuple((x is None, str(x)) for x in p))):
        if node:
            children.setdefault(node[:-1], []).append(node)
    # A node without weight gets nothing, nor does what hangs below it.
    def usable(node: tuple) -> float:
        if node in children:
            return sum(usable(c) for c in children[node] if weight(c) > 0)
        return room[node]

    out: dict[tuple, float] = {}

    def down(node: tuple, budget: float) -> None:
        if node not in children:
            out[node] = budget
            return
        kids = children[node]
        for kid, share in zip(kids, water_fill(budget, [weight(k) for k in kids], [usable(k) for k in kids])):
            down(kid, share)

    if room:
        down((), min(total, usable(())))
    return out


def mix(
    docs: DataFrame, levels: list[str], tokens: str, weight: Callable[[tuple], float], total: float | None = None,
    epochs: int = 2, seed: int = 0, key: str = "doc_id", ranges: int = RANGES,
) -> DataFrame:
    """``docs`` with copies: how many epochs take the row; rows that none takes are left out.

    ``levels`` are the columns of the tree from the top; a null is a value of its own. ``tokens`` is a column of counts; null counts
    as 0. ``total`` defaults to all tokens there are. An epoch's order is by a seeded hash of ``key``; a row is taken if its running total
    stays within the budget. Rows that share a key are ordered by their tokens and are rows of their own. Rows
    without tokens cost nothing and are taken where their place is reached, but a leaf of such rows only has no budget and is
    left out. A column named copies is replaced. An empty table gives an empty result.
    """
    copies = "copies"
    docs = docs.drop(*[c for c in docs.columns if c.lower() == copies])
    n, place, run = (fresh_name(docs, c) for c in ("mix_tokens", "mix_range", "mix_run"))
    leaf, budget_c, supply_c, before = (fresh_name(docs, c) for c in ("mix_leaf", "mix_budget", "mix_supply", "mix_before"))
    names = docs.columns
    columns = [F.col(f"`{c}`") for c in names]
    path = F.to_json(F.array(*[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null")) for c in levels]))
    rows = docs.withColumn(n, F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long")).withColumn(leaf, path)
    sums = rows.groupBy(leaf).agg(F.sum(n).alias("n"), *[F.first(f"`{c}`").alias(f"l{i}") for i, c in enumerate(levels)]).limit(
        MAX_LEAVES + 1
    ).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"over {MAX_LEAVES} leaves; choose coarser levels")
    supply = {tuple(r[f"l{i}"] for i in range(len(levels))): r.n for r in sums}
    share = budgets(supply, weight, float(sum(supply.values()) if total is None else total), epochs)
    spark = docs.sparkSession
    table = [
        (r[leaf], int(r.n), int(share[p] + 1e-6)) for r in sums for p in [tuple(r[f"l{i}"] for i in range(len(levels)))] if share.get(p, 0) > 0
    ]
    known = spark.createDataFrame(table, f"{leaf} string, {supply_c} long, {budget_c} long")  # a row per leaf, at most MAX_LEAVES
    rows = rows.join(F.broadcast(known), leaf)
    full = F.floor(F.col(budget_c) / F.col(supply_c))
    rest = F.col(budget_c) - full * F.col(supply_c)
    # Whole epochs take every row; only the last, cut one needs the order.
    hashed = F.md5(F.concat_ws("/", F.lit(str(seed)), full.cast("string"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))
    rows = rows.withColumn(run, hashed).withColumn(
        place, F.floor(F.conv(F.substring(run, 1, 8), 16, 10).cast("long") * ranges / F.lit(1 << 32))
    )
    ranged = rows.groupBy(leaf, place).agg(F.sum(n).alias("n"), F.first(rest).alias("rest"))
    ranged = ranged.withColumn(before, F.sum("n").over(Window.partitionBy(leaf).orderBy(place)) - F.col("n"))
    # One range of each leaf is cut; ranges below it are taken whole, ranges above it not at all.
    cut = ranged.select(leaf, place, before, F.when(F.col(before) + F.col("n") <= F.col("rest"), "all").when(
        F.col(before) >= F.col("rest"), "none").otherwise("some").alias("how"))
    limits = cut.filter("how <> 'all'").groupBy(leaf).agg(F.min(F.struct(place, before, "how")).alias("c")).select(
        F.col(leaf).alias("c_leaf"), F.col(f"c.{place}").alias("c_place"), F.col(f"c.{before}").alias("c_before"), F.col("c.how").alias("c_how")
    )
    joined = rows.join(F.broadcast(limits), F.col(leaf) == F.col("c_leaf"), "left")  # a row per leaf again
    whole = joined.filter(F.col("c_place").isNull() | (F.col(place) != F.col("c_place")) | (F.col("c_how") == "none"))
    taken = F.when(F.col("c_place").isNull() | (F.col(place) < F.col("c_place")), 1).otherwise(0)
    whole = whole.select(*columns, F.least(full + taken, F.lit(epochs)).cast("int").alias(copies))
    order = Window.partitionBy(leaf, place).orderBy(run, n).rowsBetween(Window.unboundedPreceding, 0)
    some = joined.filter((F.col(place) == F.col("c_place")) & (F.col("c_how") == "some"))
    some = some.withColumn("c_run", F.sum(n).over(order) + F.col("c_before")).select(
        *columns, F.least(full + F.when(F.col("c_run") <= rest, 1).otherwise(0), F.lit(epochs)).cast("int").alias(copies)
    )
    return whole.unionByName(some).filter(F.col(copies) > 0)
