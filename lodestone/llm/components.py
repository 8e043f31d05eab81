"""Connected components by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def reshuffled(df: DataFrame, key: str) -> DataFrame:
    """df dealt anew, evenly and not by the key itself, so that a join on the key shuffles both sides and Spark can split a hot key."""
    return df.repartition(F.xxhash64(key))


def least_neighbours(edges: DataFrame) -> DataFrame:
    return reshuffled(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, component (the least node it is linked with) for every node of edges (a, b), not null. Each step joins every node with
    the least of its neighbours; a node's neighbours are never gathered. Takes a number of rounds that grows as the logarithm
    of the largest component."""
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    size, before = e.count(), None
    if not size:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        # large star: a node's larger neighbours go to the least of it and its neighbours
        m = least_neighbours(both).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        m = least_neighbours(large)
        e = large.join(m, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        e = cut(e.select("e.*").where("u != v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
