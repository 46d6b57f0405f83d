"""Chat formatting with collapse of cumulative snapshots.

A logging system that stores a conversation after every turn leaves many conversations that are the beginning of a
longer one. Each turn gets the hash of the conversation up to it; a conversation whose hash is that of a proper beginning
of another is dropped by an anti-join, and equal ones leave the smallest id. The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.session import materialised

#: Turn numbers of one block; a conversation of any length is worked on block by block.
BLOCK = 1_024
#: Hash lanes of 32 bits; their sums stay exact for two thousand million turns.
LANES = 4


def _lane(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def prefix_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place (0 on), role, text, n (turns of the conversation), h0 to h3: the hash of turns 0 to place.

    The hash is the sum, lane by lane, of SHA-256 over (place, role, text), so the sums of blocks add up. Turns are in
    the order of turn, role and text, nulls first. A null text differs from an empty one. Rows without conv_id belong to no
    conversation and are left out.
    """
    t = turns.filter(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", "role", "text", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block).alias("block")
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    t = t.withColumn("local", F.row_number().over(inside) - 1)
    sizes = t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("size"))
    along = Window.partitionBy("conv_id").orderBy("block")
    sizes = sizes.withColumn("first", F.sum("size").over(along) - F.col("size")).withColumn(
        "n", F.sum("size").over(Window.partitionBy("conv_id"))
    )
    t = t.join(sizes.drop("size"), ["conv_id", "block"]).withColumn("place", F.col("first") + F.col("local"))
    digest = F.sha2(F.to_json(F.struct("place", "role", "text")).cast("binary"), 256)
    t = t.withColumn("digest", digest)
    for k in range(LANES):
        t = t.withColumn(f"d{k}", _lane(F.col("digest"), k))
    upto = Window.partitionBy("conv_id", "block").orderBy("place")
    for k in range(LANES):
        t = t.withColumn(f"s{k}", F.sum(f"d{k}").over(upto))
    sums = t.groupBy("conv_id", "block").agg(*[F.sum(f"d{k}").alias(f"b{k}") for k in range(LANES)])
    for k in range(LANES):
        sums = sums.withColumn(f"o{k}", F.sum(f"b{k}").over(along) - F.col(f"b{k}"))
    t = t.join(sums.drop(*[f"b{k}" for k in range(LANES)]), ["conv_id", "block"])
    return t.select(
        "conv_id", "place", "role", "text", "n", *[(F.col(f"s{k}") + F.col(f"o{k}")).alias(f"h{k}") for k in range(LANES)]
    )


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id and n of the conversations that begin no longer one; of equal ones the smallest id."""
    lanes = [f"h{k}" for k in range(LANES)]
    whole = hashes.filter(F.col("place") == F.col("n") - 1).groupBy("n", *lanes).agg(F.min("conv_id").alias("conv_id"))
    begun = hashes.filter(F.col("place") < F.col("n") - 1).select((F.col("place") + 1).alias("n"), *lanes).distinct()
    return whole.join(begun, ["n", *lanes], "left_anti").select("conv_id", "n")


def rendered(turns: DataFrame, part_turns: int = 512, block: int = BLOCK) -> DataFrame:
    """One row per retained conversation and part: conv_id, part, n_turns, chat.

    A turn is rendered as ``<|role|>``, newline, text, newline; a null role is ``unknown``, a null text empty. ``n_turns`` counts
    the turns of the whole conversation. Conversations over ``part_turns`` turns come in several parts, so that no row
    holds an unbounded one. Other columns of ``turns`` are ignored. An empty table gives an empty result.
    """
    hashes = materialised(prefix_hashes(turns, block), "chat")
    kept = maximal(hashes)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    lines = hashes.drop("n").join(kept, "conv_id").select(
        "conv_id", "n", F.floor(F.col("place") / part_turns).alias("part"), "place", line.alias("line")
    )
    whole = F.array_sort(F.collect_list(F.struct("place", "line")))
    return lines.groupBy("conv_id", "part").agg(
        F.first("n").alias("n_turns"), F.concat_ws("", F.transform(whole, lambda x: x["line"])).alias("chat")
    )
