"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostpulse.session import materialised


def _toward_least(pairs: DataFrame) -> DataFrame:
    """For each a with neighbours b: a, b and the least of a and its neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return pairs.join(least, F.col("a") == F.col("k")).drop("k")


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """node, component of every node of the links (a, b), both long; a component is named by its least node.

    Alternating stars: large steps hang each larger neighbour of a node on the least neighbour, small steps the smaller ones, until nothing
    changes. No task holds a component, and every round is written to the shared folder.
    """
    links = links.select("a", "b").filter("a <> b")
    stars = materialised(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), purpose)
    mark = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _toward_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _toward_least(large)
        stars = materialised(
            small.select("a", F.col("m").alias("b")).unionByName(
                small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            ).distinct(), purpose,
        )
        # Hashes as decimals, so that their sums do not overflow.
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
