"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedmatch.llm.scratch import stored

#: Hubs at most, and the links that a hub has at least.
HUBS, LEAST_HUB = 4096, 64


def components(links: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every linked node; root is the smallest node reachable.

    Each round hooks a node's larger neighbours, then its smaller ones, to the
    smallest neighbour (minima are pre-aggregated map-side); the rounds needed
    grow with the logarithm of the longest path. Every round is a written
    table. Null ends and self links are ignored. The smallest neighbour of a
    hub (a node with over ``2 / HUBS`` of the links, so ``HUBS`` at most) is
    broadcast to its links, those of other nodes are joined.
    """
    def fingerprint(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())

    state = stored(links.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "links")
    seen = fingerprint(state)
    while seen[0]:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hub = F.col("n") > max(LEAST_HUB, 4 * seen[0] // HUBS)
        marked = both.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("of_hub"))), "u", "left")
        others = marked.where("of_hub IS NULL").join(least.where(~hub).select("u", "m"), "u").select("u", "v", "m")
        met = marked.where("of_hub IS NOT NULL").select("u", "v", F.col("of_hub").alias("m")).union(others)
        large = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = fingerprint(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v"), F.col("v")).distinct())
