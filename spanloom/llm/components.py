"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import release, settled

#: Edges that one task writes, as edges never grow in number.
EDGES = 100_000


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root) for every id in ``edges`` (u, v); root is the least id of its component.

    Each round points every node's larger neighbours, then its smaller ones, at its least
    neighbour; edges only ever shrink to stars. Counts are combined before the shuffle, so
    that a node with very many edges costs one row per task. State is checkpointed each round, in as many
    files as its edges need.
    """
    now = settled(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    files = 1 + now.count() // EDGES
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").unionByName(low.select(F.col("u").alias("v"), "m"))
        last, now = now, settled(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(files))
        del both, least, large, low, small
        release(edges.sparkSession, last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
