"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

MAX_ROUNDS = 60
HUB, MOST_HUBS = 1024, 2000


def to_least(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """u, v, m: the edges (u, v) with the least neighbour m of u. least: u, m, n (edges of u).

    The edges of a node with more than ``hub`` of them meet its row where they are, by a broadcast; there are fewer than MOST_HUBS
    such nodes, since each has more than 2 / MOST_HUBS of all edge ends. The others meet theirs by a shuffle.
    """
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return edges.join(hubs, "u").select("u", "v", "m").unionByName(rest.select("u", "v", "m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: a, b (long). node and root (the smallest node of its component) for every node but the roots themselves.

    Both steps connect neighbours to the smallest one they know, so stars merge in a logarithmic number of rounds. Each step
    is a group-wise minimum, pre-aggregated before its shuffle, and a join of one row a key in which hubs take no part in the
    shuffle. Every round is a table in the shared folder; none goes to the driver.
    """
    now = scratch.keep(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % (1 << 30))).first()
        if state == before or state[0] == 0:
            break
        before, hub = state, max(HUB, 2 * state[0] // (MOST_HUBS // 2))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = to_least(both.where("v > u"), least, hub).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.distinct())
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        small = to_least(large, least, hub).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.keep(small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
        scratch.drop(now, large, least)
        now = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
