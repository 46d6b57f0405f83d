"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of ticks. Every shard owns several virtual nodes on it; a key belongs to the first
node at or after its tick. Shards have a capacity. Where a shard overflows, keys go on clockwise to the next node
whose shard has room, so that no shard exceeds its capacity and few keys move when a shard comes or goes.

Keys of one tick travel together as ranges of ranks, so that placing needs the row count of each tick only, whatever
the number of rows. At most one tick is split for each shard that fills up.
"""

from __future__ import annotations

import bisect
import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hostpulse.llm.common import fresh_name
from hostpulse.session import materialised

#: Ticks of the ring and virtual nodes a shard. Both bound what the driver places, whatever the rows.
TICKS, NODES = 8_192, 64
#: Parts of a tick: ranges of the key's hash, and of the whole row's in each.
KEY_PARTS, ROW_PARTS = 256, 64


def ring(shards: int, nodes: int = NODES, ticks: int = TICKS) -> list[tuple[int, int]]:
    """(tick, shard) of every virtual node in clockwise order."""
    spots = []
    for s in range(shards):
        for v in range(nodes):
            h = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big")
            spots.append((h % ticks, h, s))
    return [(tick, s) for tick, _, s in sorted(spots)]


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Rows each shard may hold. Without slack the capacities add up to ``total`` and differ by one at most."""
    if slack > 0:
        return [math.ceil((1 + slack) * total / shards)] * shards
    return [total // shards + (s < total % shards) for s in range(shards)]


def place(counts: dict[int, int], shards: int, slack: float = 0.0, nodes: int = NODES, ticks: int = TICKS):
    """Ranges of ranks per tick: (tick, first, past, shard, slot of the first), in the order of arrival.

    In every round each shard takes what has arrived, the shortest way first, as far as it has room; the rest moves to
    the next node clockwise whose shard had room when the round ended.
    """
    spots = ring(shards, nodes, ticks)
    room, filled = capacities(sum(counts.values()), shards, slack), [0] * shards
    at = [t for t, _ in spots]
    waiting = [(t, 0, n, bisect.bisect_left(at, t) % len(spots), 0) for t, n in sorted(counts.items()) if n]
    placed = []
    while waiting:
        arrived: dict[int, list] = {}
        for t, a, b, spot, way in waiting:
            arrived.setdefault(spots[spot][1], []).append((way, t, a, b, spot))
        over = []
        for s in sorted(arrived):
            for way, t, a, b, spot in sorted(arrived[s]):
                take = min(b - a, room[s])
                if take:
                    placed.append((t, a, a + take, s, filled[s]))
                    filled[s] += take
                    room[s] -= take
                if a + take < b:
                    over.append((t, a + take, b, spot, way))
        waiting = []
        for t, a, b, spot, way in over:
            step = next(k for k in range(1, len(spots) + 1) if room[spots[(spot + k) % len(spots)][1]] > 0)
            waiting.append((t, a, b, (spot + step) % len(spots), way + step))
    return placed


def assign_shards(
    rows: DataFrame, key: str, shards: int = 40, slack: float = 0.0, nodes: int = NODES, ticks: int = TICKS,
) -> DataFrame:
    """``rows`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard).

    Without slack the row counts of two shards differ by one at most; with it no shard exceeds (1 + slack) times the
    mean. A null key has a tick of its own like any value. Rows of one key may overflow to several shards, so a key
    that holds most rows is spread too. Repeated rows are rows of their own. Columns named shard or slot are replaced.
    An empty table gives an empty result. Shard and slot follow from the rows alone, however they are split over files
    and tasks; only rows that are equal in all columns (by 64 bits of their hash) may change places.
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("shard", "slot")])
    tick, part, content, source, number = (fresh_name(rows, c) for c in ("tick", "part", "content", "source", "number"))
    of_key = F.xxhash64(F.col(f"`{key}`").cast("string"))
    of_row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rows.columns])
    # Rows of a tick are in the order of fixed parts: ranges of the key's hash, then of the row's, so that a hot key has many.
    at = F.shiftrightunsigned(of_key, 24).bitwiseAND(F.lit(KEY_PARTS - 1)) * ROW_PARTS + F.shiftrightunsigned(of_row, 32).bitwiseAND(F.lit(ROW_PARTS - 1))
    # Written first, so that a row keeps its number whatever is computed again. Only the small columns are ranked.
    cut = materialised(rows.withColumns({
        tick: F.pmod(of_key, F.lit(ticks)).cast("int"), part: at.cast("int"), content: of_row, source: F.spark_partition_id(),
        number: F.monotonically_increasing_id(),
    }), "sharding")
    names = {"tick": tick, "part": part, "content": content, "source": source, "number": number}
    small = cut.select(*[F.col(c).alias(n) for n, c in names.items()])
    # Equal rows count once per read partition, so that many copies meet in no task.
    same = ["tick", "part", "content", "source"]
    sizes = small.groupBy(*same).agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.groupBy("tick", "part").agg(F.sum("n").alias("m"))
    ahead = parts.select("tick", "part", (F.sum("m").over(Window.partitionBy("tick").orderBy("part")) - F.col("m")).alias("ahead"))
    within = F.sum("n").over(Window.partitionBy("tick", "part").orderBy("content", "source")) - F.col("n")
    before = sizes.withColumn("within", within).join(ahead, ["tick", "part"]).select(*same, (F.col("ahead") + F.col("within")).alias("before"))
    ranked = small.withColumn("rank", F.row_number().over(Window.partitionBy(*same).orderBy("number")) - 1)
    totals = {t: n for t, n in parts.groupBy("tick").agg(F.sum("m")).collect()}  # at most ``ticks`` rows
    ranges = rows.sparkSession.createDataFrame(
        place(totals, shards, slack, nodes, ticks), "r_tick int, r_from long, r_to long, shard int, r_slot long"
    )  # at most ticks + shards rows
    spot = F.col("before") + F.col("rank")
    placed = (
        ranked.join(before, same)
        .join(F.broadcast(ranges), (F.col("tick") == F.col("r_tick")) & (spot >= F.col("r_from")) & (spot < F.col("r_to")))
        .select(F.col("number").alias("p_number"), "shard", (F.col("r_slot") + spot - F.col("r_from")).alias("slot"))
    )
    return cut.join(placed, F.col(number) == F.col("p_number")).select(*[F.col(f"`{c}`") for c in rows.columns], "shard", "slot")
